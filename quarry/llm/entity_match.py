"""Matching records of two sources without keys: sorted neighbourhoods and one-to-one assignment."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import names as N
from quarry.llm.groups import components
from quarry.llm.markup import SUSPECT, blocks_of, parse
from quarry.llm.name_variants import known_given
from quarry.runtime import cut, spread, tasks

#: Sorted positions, of both sources, that a form is compared over on either side, for every sort key.
WINDOW = 24
#: Pairs of forms that share a sort key and are simply listed; in a larger run those are left out that
#: ``_confidence`` is sure to refuse.  What is found does not depend on it.
RUN_PAIRS = 10_000
#: Parts of a large run of which each task pairs one with the forms that lack authors.
SALTS = 32
#: Sorted positions that one block of the sliding window spans.
BLOCK = 4_096
#: Weights of the field similarities; a field that is missing on a side is left out.
WEIGHTS = {"title": 0.45, "authors": 0.25, "journal": 0.2, "year": 0.1}
#: Records whose years are further apart are never one.
YEARS = 3
#: What is compared of a record; records of one side that agree in all of it are one form.
FIELDS = ["title", "torn", "people", "year", "letters", "place"]
#: Confidence from which two records may be one.
LEAST = 0.72

_suspect = re.compile(SUSPECT.replace("(?m)", ""), re.M)
# Words that tell a sequel or a part from the paper itself.
PARTS = frozenset("ii iii iv v vi vii viii ix part parts continued continuation details sequel addendum supplement erratum corrigendum revisited 2 3 4 5".split())
# End.


def _words(title: str) -> tuple[list[str], bool]:
    """Folded words of a title without markup, and whether it was cut short."""
    if _suspect.search(title):
        root, kinds = parse(title)
        title = " ".join(t for _, t in blocks_of(root)) if kinds else title
    folded = N.fold(title)
    return re.findall(r"[^\W_]+", folded), folded.rstrip().endswith(("...", "…"))


def _place(journal: str) -> tuple[str, str]:
    """(letters of the journal, volume:page) of a printed journal reference."""
    text = N.fold(journal)
    bare = re.sub(r"\((?:1[89]|20)[0-9]{2}\)", " ", text)
    head = re.split(r"[0-9]", bare, maxsplit=1)[0]
    numbers = re.findall(r"[0-9]+", bare)
    letters = re.sub(r"[^a-z]", "", re.sub(r"\b(vol|p|pp|no)\b\.?", "", head))
    return letters, f"{numbers[0]}:{numbers[1]}" if len(numbers) > 1 else ""


@lru_cache(maxsize=50_000)
def _surname(name: str, given: frozenset[str]) -> str:
    parsed = N.parse_name(name, given)
    return parsed[1].replace("-", "")[:24] if parsed else ""


def _features(given):
    """Comparable fields and sort keys of a record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = given.value
        for batch in batches:
            rows = []
            for side, key, scope, title, authors, year, journal in zip(*(batch[c] for c in ("side", "key", "scope", "title", "authors", "year", "journal"))):
                words, torn = _words(title) if title else ([], False)
                people = [s for a in (authors if authors is not None else []) if a and (s := _surname(a, known))]
                letters, place = _place(journal) if journal else ("", "")
                year = None if pd.isna(year) else int(year)
                first = min(people) if people else ""
                keys = []
                if words:
                    keys.append("1" + " ".join(words))
                    keys.append("2" + " ".join(reversed(words[:-1] if torn else words)))
                    keys.append("3" + " ".join(sorted(words, key=lambda w: (-len(w), w))[:4]))
                    keys.append("4" + first + " " + " ".join(words[1:4]))
                if place:
                    keys.append(f"5{place}:{letters[:4]}")
                if people and year:
                    keys.append(f"6{first}:{year}:{place or ' '.join(words)}")
                    keys.append(f"7{people[0]}:{year}:{' '.join(words)}")
                rows.append((side, key, scope, " ".join(words), torn, people, year, letters, place, keys))
            yield pd.DataFrame(rows, columns=["side", "key", "scope", "title", "torn", "people", "year", "letters", "place", "keys"]).astype({"year": "Int64"})

    return run


@lru_cache(maxsize=200_000)
def _alike(p: str, q: str) -> bool:
    """Surnames one slip apart, or one the beginning of the other."""
    return len(p) > 4 and (N.within_one(p, q) or (len(p) > 5 and (q.startswith(p) or p.startswith(q))))


def _title(a: str, b: str, torn_a: bool, torn_b: bool) -> float:
    """Likeness of two different titles: edits of the whole, less for every telling word without a counterpart."""
    wa, wb = a.split(), b.split()
    only_a, only_b = [w for w in wa if w not in set(wb)], [w for w in wb if w not in set(wa)]
    if torn_a or torn_b:
        n = min(len(a), len(b)) if torn_a == torn_b else len(a) if torn_a else len(b)
        if n < 12:
            return 0.0
        x, y = a[:n], b[:n]
        alike = 1.0 if x == y else 1 - N.levenshtein(x, y) / n
        return alike if alike >= 0.75 else 0.0
    if [w for w in wa[-4:] if w in PARTS] != [w for w in wb[-4:] if w in PARTS] and (len(wa) != len(wb) or PARTS & (set(wa[-3:]) ^ set(wb[-3:]))):
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) > 24 and len(long) > 1.25 * len(short) and long.startswith(short):
        return 0.85
    if len(only_a) > 1 + len(wa) // 2 and abs(len(a) - len(b)) > 3:
        return 0.0
    alike = 1 - N.levenshtein(a, b) / len(long) if 4 * len(short) >= 3 * len(long) else 0.0
    if alike < 0.75:
        return 0.85 if len(short) > 24 and long.startswith(short) else 0.0
    for w in only_a:
        if len(w) > 3 and not any(abs(len(w) - len(v)) <= 2 and (N.within_one(w, v) or N.levenshtein(v, w) <= len(w) // 4) for v in only_b):
            alike -= 0.25
    return alike


def similarity(a: tuple, b: tuple) -> float:
    """Confidence that records (title, torn, people, year, letters, place) are one publication."""
    title_a, torn_a, people_a, year_a, letters_a, place_a = a
    title_b, torn_b, people_b, year_b, letters_b, place_b = b
    score = weight = 0.0
    if title_a and title_b:
        torn = torn_a or torn_b
        alike = 1.0 if title_a == title_b else _title(title_a, title_b, torn_a, torn_b)
        if alike <= 0.0:
            return 0.0
        score += WEIGHTS["title"] * alike
        weight += WEIGHTS["title"]
    if people_a and people_b:
        few, many = (people_a, people_b) if len(people_a) <= len(people_b) else (people_b, people_a)
        known = set(many)
        hits = sum(p in known or any(_alike(p, q) for q in many) for p in few)
        if not hits:
            return 0.0
        score += WEIGHTS["authors"] * hits / len(few)
        weight += WEIGHTS["authors"]
    if place_a and place_b:
        same = place_a == place_b
        score += WEIGHTS["journal"] * same
        weight += WEIGHTS["journal"]
        if not same and not (title_a and title_b):
            return 0.0
    elif not (title_a and title_b):
        return 0.0
    if year_a and year_b:
        gap = abs(year_a - year_b)
        score += WEIGHTS["year"] * (1.0 if gap == 0 else 0.7 if gap == 1 else 0.3 if gap == 2 else 0.0)
        weight += WEIGHTS["year"]
    if weight < 0.5:
        if title_a and title_b and len(title_a) >= 20:
            return 0.9 * score / weight if score >= 0.95 * weight else 0.0
        return score / weight * 0.8 if place_a and place_a == place_b and people_a and people_b else 0.0
    return score / weight


def _ends(people: list[str]) -> frozenset[str]:
    """First and last two letters of the surnames that may be alike to others.

    One slip leaves the first or the last two letters of five as they are, and so does a cut, so
    records that share none of these have no surnames alike.
    """
    return frozenset(x for p in people if len(p) > 3 for x in ("<" + p[:2], ">" + p[-2:]))


def _sketch(people) -> tuple[list[str], frozenset[str], frozenset[str]]:
    people = list(people)
    return people, frozenset(people), _ends(people)


def _confidence(a: tuple, b: tuple) -> float:
    """similarity() of two records with sketched people, 0 where years or authors rule it out."""
    if a[3] and b[3] and abs(a[3] - b[3]) > YEARS:
        return 0.0
    (mine, own, ends), (theirs, names, tails) = a[2], b[2]
    if own and names and own.isdisjoint(names):  # similarity() is 0 without a common author
        if ends.isdisjoint(tails) or not any(_alike(p, q) or _alike(q, p) for p in own for q in names):
            return 0.0
    return similarity((*a[:2], mine, *a[3:]), (*b[:2], theirs, *b[3:]))


def _windows(window: int):
    """Slide over the sorted rows of each block and compare forms of different sides at most ``window`` positions apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, near = None, deque(maxlen=window)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for row in zip(*(batch[c] for c in ("block", "run", "side", "form", "title", "torn", "people", "year", "letters", "place"))):
                at, sort, side, form, title, torn, people, year, letters, place = row
                if (at, sort) != block:
                    block, seen = (at, sort), set()
                    near.clear()
                fields = (title, torn, _sketch(people), None if pd.isna(year) else int(year), letters, place)
                for there, other, theirs in near:
                    if there == side:
                        continue
                    pair = (form, other) if side == 0 else (other, form)
                    if pair not in seen:
                        seen.add(pair)
                        if (confidence := _confidence(fields, theirs)) >= LEAST:
                            out.append((*pair, confidence))
                near.append((side, form, fields))
            yield pd.DataFrame(out, columns=["left_form", "right_form", "confidence"])

    return run


def _equals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the pairs of forms that share a sort key."""
    for batch in batches:
        out = []
        for left, right, *both in zip(*(batch[c] for c in ("left_form", "right_form", *(c + s for s in ("", "_r") for c in FIELDS)))):
            a, b = ((t, torn, _sketch(p), None if pd.isna(y) else int(y), l, v) for t, torn, p, y, l, v in (both[:6], both[6:]))
            if (confidence := _confidence(a, b)) >= LEAST:
                out.append((left, right, confidence))
        yield pd.DataFrame(out, columns=["left_form", "right_form", "confidence"])


def _name_tokens(side: int) -> Column:
    """Tokens of ``people``: two lists with an equal or alike surname, and few others, have one in common.

    Names one slip apart are equal after the loss of at most one letter each.  Of a name and its
    beginning both have the first four letters, or the shorter one is the token of its own side.
    """
    whole = "transform(people, p -> concat('~', p))"
    lost = "flatten(transform(people, p -> transform(sequence(1, length(p)), i -> concat('~', substring(p, 1, i - 1), substring(p, i + 1)))))"
    begun = "transform(filter(people, p -> length(p) > 3), p -> concat('<', left(p, 4)))"
    short = f"transform(filter(people, p -> length(p) < 4), p -> concat('{side}', p))"
    long = f"flatten(transform(filter(people, p -> length(p) > 5), p -> transform(sequence(1, 3), i -> concat('{1 - side}', left(p, i)))))"
    return F.expr(f"array_distinct(concat({whole}, {lost}, {begun}, {short}, {long}))")


def _shared(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """(left_form, right_form) of forms that share a sort key, but for pairs of large runs that cannot be alike.

    In a run of over ``RUN_PAIRS`` two forms with authors meet where they have a token of a surname in
    common, and a form without authors meets all others.  Years more than ``YEARS`` apart never match,
    nor do, where a form lacks authors, two different places unless the years are equal: that leaves
    title and year 0.52 of 0.75 at most.
    """
    rows = rows.withColumn("sort", F.xxhash64("sort"))  # a clash only adds pairs, and each is compared
    sides = F.count_if(F.col("side") == 0) * F.count_if(F.col("side") == 1)
    hot = cut(rows.groupBy("sort").agg(sides.alias("pairs")).filter(F.col("pairs") > RUN_PAIRS).select("sort"))
    names = ("left_form", "right_form")

    def halves(df: DataFrame, *columns: str) -> list[DataFrame]:
        return [df.filter(F.col("side") == i).select(*columns, F.col("form").alias(n), *(F.col(c).alias(f"{c}_{i}") for c in df.columns if c in ("year", "place", "bare"))) for i, n in enumerate(names)]

    if hot.isEmpty():
        left, right = halves(rows, "sort")
        return left.join(right, "sort").select(*names).distinct()
    left, right = halves(rows.join(hot, "sort", "left_anti"), "sort")
    plain = left.join(right, "sort").select(*names)
    large = cut(rows.join(hot, "sort", "left_semi").join(forms.select("side", "form", "people", "year", "place"), ["side", "form"]).withColumn("bare", F.size("people") == 0))
    near = F.coalesce(F.abs(F.col("year_0") - F.col("year_1")) <= YEARS, F.lit(True))
    told = large.withColumn("token", F.explode(F.when(F.col("side") == 0, _name_tokens(0)).otherwise(_name_tokens(1))))
    left, right = halves(told, "sort", "token")
    named = left.join(right, ["sort", "token"]).filter(near).select(*names)
    left, right = halves(large, "sort")
    left = left.withColumn("salt", F.pmod(F.xxhash64("left_form"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = (F.col("place_0") == "") | (F.col("place_1") == "") | (F.col("place_0") == F.col("place_1")) | F.coalesce(F.col("year_0") == F.col("year_1"), F.lit(False))
    bare = [l.join(r, ["sort", "salt"]).filter(near & placed).select(*names) for l, r in ((left.filter("bare_0"), right), (left.filter("not bare_0"), right.filter("bare_1")))]
    return plain.unionByName(named).unionByName(bare[0]).unionByName(bare[1]).distinct()


def _positions(rows: DataFrame) -> DataFrame:
    """Global positions in the order of ``sort``, without gathering: place in a range plus the ranges before it."""
    ranged = rows.repartitionByRange(tasks(rows.sparkSession), "sort", "side", "form").sortWithinPartitions("sort", "side", "form")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "part").withColumn("position", F.col("start") + F.col("at")).drop("part", "at", "start")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key, scope, confidence) of the pairs that some neighbourhood finds alike.

    ``left`` and ``right`` have key, scope, title, authors, year and journal.  Only distinct forms
    are compared: those that share a sort key, and those at most ``WINDOW`` positions apart in the
    order of a key; a block is handed to one task with the ``WINDOW`` rows before it, so the pairs do
    not depend on where blocks begin.  What holds for two forms
    holds for all of their records.  Of equal right records a scope gets the first by key, as many
    as it has left records for them; an assignment has no use for more.
    """
    columns = ["side", "key", "scope", "title", "authors", "year", "journal"]
    both = left.withColumn("side", F.lit(0)).select(columns).unionByName(right.withColumn("side", F.lit(1)).select(columns))
    people = both.select(F.explode("authors").alias("name")).filter("name is not null")
    given = both.sparkSession.sparkContext.broadcast(known_given(people))
    schema = "side int, key long, scope string, title string, torn boolean, people array<string>, year long, letters string, place string, keys array<string>"
    records = spread(both).mapInPandas(_features(given), schema).filter("title <> '' or place <> ''")
    records = cut(records.withColumn("same", F.md5(F.to_json(F.struct(*FIELDS)))))
    forms = cut(records.groupBy("side", "same", *FIELDS, "keys").agg(F.min("key").alias("form"), F.count("*").alias("copies")))
    rows = forms.select("side", "form", F.explode("keys").alias("sort"))
    placed = _positions(rows)
    first = F.floor(F.col("position") / BLOCK)
    spans = F.when(F.col("position") % BLOCK >= BLOCK - WINDOW, F.array(first, first + 1)).otherwise(F.array(first))
    placed = placed.select("side", "form", F.substring("sort", 1, 1).alias("run"), "position", F.explode(spans).alias("block"))
    full = placed.join(forms.select("side", "form", *FIELDS), ["side", "form"])
    full = full.repartition(tasks(both.sparkSession), "block").sortWithinPartitions("block", "run", "position")
    kind = "left_form long, right_form long, confidence double"
    lefts = forms.filter("side = 0").withColumnRenamed("form", "left_form")
    rights = forms.filter("side = 1").withColumnRenamed("form", "right_form")
    shared = _shared(rows, forms).join(lefts.select("left_form", *FIELDS), "left_form")
    shared = shared.join(rights.select("right_form", *(F.col(c).alias(c + "_r") for c in FIELDS)), "right_form")
    found = full.mapInPandas(_windows(WINDOW), kind).unionByName(shared.mapInPandas(_equals, kind))
    found = found.groupBy("left_form", "right_form").agg(F.max("confidence").alias("confidence"))
    mine = records.filter("side = 0").join(lefts.select("same", "left_form"), "same").select("left_form", F.col("key").alias("left_key"), "scope")
    order = Window.partitionBy("right_form").orderBy("key")
    theirs = records.filter("side = 1").join(rights.select("same", "right_form"), "same").select("right_form", F.col("key").alias("right_key"), F.row_number().over(order).alias("place"))
    pairs = found.join(mine, "left_form").join(rights.select("right_form", "copies"), "right_form")
    wanted = F.count("*").over(Window.partitionBy("scope", "right_form"))
    pairs = pairs.withColumn("wanted", F.least("copies", wanted)).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("wanted").cast("int"))))
    return pairs.join(theirs, ["right_form", "place"]).select("left_key", "right_key", "scope", "confidence").distinct()


def _assign(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one assignment of largest total confidence on a sparse graph, by augmenting paths.

    Every left record may also stay alone at no gain, so an augmentation is the best path from a
    left record to a free right record or to giving up one; ties fall to the smaller key.
    """
    gain: dict[int, dict[int, float]] = defaultdict(dict)
    for left, right, confidence in sorted(edges):
        gain[left][right] = max(confidence, gain[left].get(right, 0.0))
    owner: dict[int, int] = {}
    taken: dict[int, int] = {}
    for start in sorted(gain):
        best: dict[int, float] = {start: 0.0}
        through: dict[int, tuple[int, int]] = {}
        changed = [start]
        while changed:  # Bellman-Ford over the alternating graph
            later = []
            for left in changed:
                for right, value in gain[left].items():
                    if taken.get(left) == right or right not in owner:
                        continue
                    other = owner[right]
                    total = best[left] + value - gain[other][right]
                    if total > best.get(other, -1e18) + 1e-12:
                        best[other], through[other] = total, (left, right)
                        later.append(other)
            changed = later
        options = []
        for left, total in best.items():
            if left != start:
                options.append((total, 0, left, None))
            options += [(total + value, 1, left, right) for right, value in gain[left].items() if right not in owner]
        if not options:
            continue
        total, _, left, right = max(options, key=lambda o: (o[0], o[1], -o[2], -(o[3] or 0)))
        if total <= 0:
            continue
        path = []
        while left != start:
            before, via = through[left]
            path.append((left, right))
            left, right = before, via
        path.append((left, right))
        for l, _ in path:
            if l in taken:
                del owner[taken.pop(l)]
        for l, r in path:
            if r is not None:
                owner[r], taken[l] = l, r
    return [(l, r, gain[l][r]) for l, r in taken.items()]


def _assignments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting, group = [], None
    for batch in batches:
        out = []
        for key, rows in groupby(zip(batch["group_id"], batch["left_key"], batch["right_key"], batch["confidence"]), key=lambda r: r[0]):
            if key != group:
                out += _assign(waiting)
                waiting, group = [], key
            waiting += [r[1:] for r in rows]
        yield pd.DataFrame(out, columns=["left_key", "right_key", "confidence"])
    yield pd.DataFrame(_assign(waiting), columns=["left_key", "right_key", "confidence"])


def match_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key, confidence): for each left record the right record it means, if any.

    Within a scope (the records of one list) no right record is meant twice: candidates are split
    into connected groups and each is assigned so that the total confidence is largest.  Different
    scopes may mean the same right record; a left record of null scope is a scope of its own.
    Null fields are left out of the comparison; records with neither title nor a full journal
    reference match nothing; ties fall to the smaller key; empty tables give no rows.
    """
    scoped = left.withColumn("scope", F.coalesce(F.concat(F.lit("s"), "scope"), F.concat(F.lit("k"), F.col("key").cast("string"))))
    found = cut(candidates(scoped, right))
    edges = found.select(F.col("left_key").alias("a"), (-F.abs(F.xxhash64("scope", "right_key"))).alias("b"))
    group = components(edges).select(F.col("node").alias("left_key"), "group_id")
    work = found.join(group, "left_key").select("group_id", "left_key", "right_key", "confidence")
    work = work.repartition(tasks(left.sparkSession), "group_id").sortWithinPartitions("group_id", "left_key", "right_key")
    return work.mapInPandas(_assignments, "left_key long, right_key long, confidence double")
