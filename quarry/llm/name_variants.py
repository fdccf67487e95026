"""Variant spellings of names: metric-space partitioning of surnames, then persons within them."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import names as N
from quarry.runtime import cut, spread, tasks

#: Edits between names that are joined, pivots whose distances place a name, sample they are chosen from.
RADIUS = 2
PIVOTS = 16
SAMPLE = 4_096
#: Names that a cell is split down to, and that one task holds of a cell that cannot be split.
CELL = 2_000
#: Longest name that bit vectors hold; longer ones are measured one by one.
WORD = 63
#: Letters from which one edit, and from which two, may be a slip without or with an equal first name.
ONE_EDIT, TWO_EDITS = 5, 8
#: Words kept as known given names reach this share of all given words, so there are at most so many.
GIVEN_WORDS = 20_000

def _given_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for name in batch["name"]:
            parsed = N.parse_name(name) if "," in name or "，" in name else None
            if parsed and parsed[0] == "person":
                counts.update(p for p in parsed[2] if len(p) > 2)
        yield pd.DataFrame(list(counts.items()), columns=["word", "n"])


def known_given(found: DataFrame) -> frozenset[str]:
    """Given names that stand after a comma often enough; bounded by ``GIVEN_WORDS``."""
    words = found.select("name").mapInPandas(_given_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["word"] for r in words.filter(F.col("n") >= max(3, total // GIVEN_WORDS)).collect())


def parsed_names(found: DataFrame) -> DataFrame:
    """(name, kind, surname, given) of the distinct strings of ``found.name`` that name somebody."""
    distinct = cut(spread(found.select("name").filter("name is not null and name <> ''").distinct()))
    known = distinct.sparkSession.sparkContext.broadcast(known_given(distinct))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, *p) for name in batch["name"] if (p := N.parse_name(name, known.value))]
            yield pd.DataFrame([(n, k, s, list(g)) for n, k, s, g in rows], columns=["name", "kind", "surname", "given"])

    return cut(distinct.mapInPandas(run, "name string, kind string, surname string, given array<string>"))


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names, padded, and their lengths; of over-long names only the length counts."""
    lengths = np.array([len(n) for n in names], np.int32)
    width = max(1, min(WORD, int(lengths.max(initial=1))))
    codes = np.zeros((len(names), width), np.uint32)
    for row, name in zip(codes, names):
        if len(name) <= WORD:
            row[: len(name)] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, lengths


def pivot_distances(names: list[str], pivots: list[str]) -> np.ndarray:
    """Levenshtein distances of names to pivots, one row for each name: bit vectors of all names at once."""
    codes, lengths = _codes(names)
    out = np.zeros((len(names), len(pivots)), np.int32)
    one = np.uint64(1)
    for at, pivot in enumerate(pivots):
        signs = sorted(set(pivot))
        table = np.array([sum(1 << i for i, c in enumerate(pivot) if c == sign) for sign in signs], np.uint64)
        keys = np.array([ord(sign) for sign in signs], np.uint32)
        place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        equal = np.where(keys[place] == codes, table[place], np.uint64(0))
        plus = np.full(len(names), (1 << len(pivot)) - 1, np.uint64)
        minus, top = np.zeros(len(names), np.uint64), np.uint64(len(pivot) - 1)
        score = np.full(len(names), len(pivot), np.int32)
        for i in range(codes.shape[1]):
            e, inside = equal[:, i], i < lengths
            vertical = e | minus
            across = (((e & plus) + plus) ^ plus) | e
            up, down = minus | ~(across | plus), plus & across
            score += inside * (((up >> top) & one).astype(np.int32) - ((down >> top) & one).astype(np.int32))
            up, down = (up << one) | one, down << one
            plus, minus = down | ~(vertical | up), up & vertical
        out[:, at] = score
    for i in np.flatnonzero(lengths > WORD):
        out[i] = [N.levenshtein(names[i], p) for p in pivots]
    return out


class Batch:
    """Names as arrays: code points, lengths, letters as bits, distances to the pivots."""

    def __init__(self, names: list[str], vectors: np.ndarray | None = None) -> None:
        self.names = names
        self.codes, self.lengths = _codes(names)
        bits = np.where(np.arange(self.codes.shape[1]) < self.lengths[:, None], np.uint64(1) << (self.codes % 64).astype(np.uint64), np.uint64(0))
        self.letters = np.bitwise_or.reduce(bits, axis=1)
        self.letters[self.lengths > WORD] = 0
        self.vectors = np.zeros((len(names), 0), np.int16) if vectors is None else vectors


def near(left: Batch, i: np.ndarray, right: Batch, j: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Levenshtein distances of pairs of names, ``radius`` + 1 for all that are further apart: a band of all tables at once."""
    m, n, far = left.lengths[i], right.lengths[j], radius + 1
    out = np.full(len(i), far, np.int8)
    width = max(left.codes.shape[1], right.codes.shape[1]) + radius + 1
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=pad) for x, pad in ((left.codes[i], 0), (right.codes[j], 1)))
    gap = n - m
    band = {k: np.full(len(i), k if k >= 0 else far, np.int8) for k in range(-radius, radius + 1)}
    for row in range(min(WORD, int(m.max(initial=0))) + 1):
        if row:
            fresh: dict[int, np.ndarray] = {}
            for k in range(-radius, radius + 1):
                column = row + k
                if column < 0:
                    fresh[k] = np.full(len(i), far, np.int8)
                    continue
                best = np.full(len(i), row, np.int8) if column == 0 else band[k] + (a[:, row - 1] != b[:, column - 1])
                if k > -radius and column > 0:
                    best = np.minimum(best, fresh[k - 1] + 1)
                if k < radius:
                    best = np.minimum(best, band[k + 1] + 1)
                fresh[k] = np.minimum(best, far).astype(np.int8)
            band = fresh
        for k in range(-radius, radius + 1):
            done = (m == row) & (gap == k)
            out[done] = band[k][done]
    for at in np.flatnonzero((m > WORD) | (n > WORD)):
        out[at] = min(far, N.levenshtein(left.names[i[at]], right.names[j[at]])) if abs(gap[at]) <= radius else far
    return out


def close(left: Batch, right: Batch, radius: int = RADIUS) -> Iterator[tuple[str, str, int]]:
    """Pairs of names of two batches within the radius.

    What cannot be within it is left out first: an edit changes at most two letters of those that
    occur, and no distance to a pivot by more than one.
    """
    for start in range(0, len(left.names), 1_000):
        few = np.bitwise_count(left.letters[start: start + 1_000, None] ^ right.letters[None, :]) <= 2 * radius
        few[left.lengths[start: start + 1_000] > WORD] = True
        few[:, right.lengths > WORD] = True
        i, j = np.nonzero(few)
        i += start
        for k in range(left.vectors.shape[1]):
            stays = np.abs(left.vectors[i, k] - right.vectors[j, k]) <= radius
            i, j = i[stays], j[stays]
        apart = near(left, i, right, j, radius)
        for x, y, d in zip(i[apart <= radius], j[apart <= radius], apart[apart <= radius]):
            if d:
                p, q = left.names[x], right.names[y]
                yield min(p, q), max(p, q), int(d)


def choose_pivots(sample: list[str], count: int = PIVOTS) -> list[str]:
    """Pivots far from each other: each next one is the name furthest from all before it."""
    short = [s for s in sample if 0 < len(s) <= WORD]
    pivots = short[:1]
    least = None
    while pivots and len(pivots) < min(count, len(short)):
        last = pivot_distances(short, pivots[-1:])[:, 0]
        least = last if least is None else np.minimum(least, last)
        if least.max() == 0:
            break
        pivots.append(short[int(least.argmax())])
    return pivots


def cell_tree(vectors: np.ndarray, total: int, radius: int = RADIUS, depth: int = 0) -> tuple:
    """A tree of cuts in pivot distances, from the vectors of a sample of ``total`` names: (pivot, cut, near, far) or ().

    Of all cuts the one is taken that leaves the fewest comparisons, those of boundary names included.
    """
    held = len(vectors)
    if held < 8 or total <= CELL or depth >= 14:
        return ()
    best, choice = 0.9 * held * held, ()
    for pivot in range(vectors.shape[1]):
        column = vectors[:, pivot]
        for cut_at in np.unique(column)[:-1]:
            inner = int((column <= cut_at).sum())
            edge = int(((column <= cut_at) & (column > cut_at - radius)).sum())
            cost = inner * inner + (held - inner) * (held - inner + edge)
            if cost < best:
                best, choice = cost, (pivot, int(cut_at))
    if not choice:
        return ()
    pivot, cut_at = choice
    inside = vectors[:, pivot] <= cut_at
    parts = [cell_tree(v, total * len(v) // held, radius, depth + 1) for v in (vectors[inside], vectors[~inside])]
    return pivot, cut_at, *parts


def place(tree: tuple, vectors: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(cell, names at home there, names that visit it) for the vectors of names.

    A name is at home in one cell.  By the triangle inequality two names within the radius differ by
    no more in the distance to any pivot, so where a cut parts them the nearer one visits the cell
    of the other, and no pair is missed.
    """
    def walk(node: tuple, cell: str, home: np.ndarray, guests: np.ndarray):
        if not node:
            yield cell, home, guests
            return
        pivot, cut_at, inner, outer = node
        mine, theirs = vectors[home, pivot], vectors[guests, pivot]
        edge = home[(mine <= cut_at) & (mine > cut_at - radius)]
        yield from walk(inner, cell + "0", home[mine <= cut_at], guests[theirs <= cut_at + radius])
        yield from walk(outer, cell + "1", home[mine > cut_at], np.concatenate([guests[theirs > cut_at - radius], edge]))

    yield from walk(tree, "", np.arange(len(vectors)), np.zeros(0, np.int64))


def _placed(pivots: list[str], tree: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = list(batch["surname"])
            vectors = pivot_distances(names, pivots)
            packed = [v.tobytes() for v in vectors.astype(np.int16)]
            rows = []
            for cell, home, guests in place(tree, vectors):
                rows += [(cell, True, names[i], packed[i]) for i in home] + [(cell, False, names[i], packed[i]) for i in guests]
            yield pd.DataFrame(rows, columns=["cell", "home", "surname", "vector"])

    return run


def _join_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact radius joins: the names at home in a part of a cell, which come first, with all names in the cell."""
    at, names, packed, homes = None, [], [], None

    def arrays(surnames: list[str], vectors: list[bytes]) -> Batch:
        return Batch(surnames, np.stack([np.frombuffer(v, np.int16) for v in vectors]))

    for batch in batches:
        found = []
        for key, rows in batch.groupby(["cell", "part"], sort=False):
            if key != at:
                at, names, packed, homes = key, [], [], None
            first, others = rows[rows["role"] == 0], rows[rows["role"] == 1]
            names += list(first["surname"])
            packed += list(first["vector"])
            if names and len(others):
                homes = homes or arrays(names, packed)
                found += close(homes, arrays(list(others["surname"]), list(others["vector"])))
        yield pd.DataFrame(found, columns=["a", "b", "edits"])


def cells(names: DataFrame) -> DataFrame:
    """(cell, home, surname, vector): distinct names (surname) in the cells of pivots, visitors included.

    The pivots and the tree of cuts are fitted on the ``SAMPLE`` names of smallest hash; every name is placed.
    """
    sample = [r["surname"] for r in names.orderBy(F.xxhash64("surname"), "surname").limit(SAMPLE).collect()]
    pivots = choose_pivots(sample)
    tree = cell_tree(pivot_distances(sample, pivots), names.count()) if pivots else ()
    return names.mapInPandas(_placed(pivots, tree), "cell string, home boolean, surname string, vector binary")


def close_surnames(surnames: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of different names at Levenshtein distance 1 or 2: (a, b, edits).

    Cells of pivot distances are the only source of candidates.  A cell that more than ``CELL`` names
    call home is parted by their hash, and each part meets all names of the cell, so no task holds a
    whole cell; within it pairs that some pivot's distances rule out are not measured.
    """
    names = cut(spread(surnames.select("surname").filter("surname <> ''").distinct()))
    placed = cut(cells(names))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / CELL).cast("int").alias("parts"))  # a row for each leaf of the tree
    placed = placed.join(F.broadcast(sizes), "cell").filter("parts > 0")
    homes = placed.filter("home").withColumn("part", F.pmod(F.xxhash64("surname"), F.col("parts")).cast("int")).withColumn("role", F.lit(0))
    members = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(1))
    columns = ["cell", "part", "role", "surname", "vector"]
    rows = homes.select(columns).unionByName(members.select(columns)).repartition(tasks(names.sparkSession), "cell", "part")
    return rows.sortWithinPartitions("cell", "part", "role", "surname").mapInPandas(_join_cells, "a string, b string, edits int").distinct()


def slips(pairs: DataFrame, support: DataFrame, firsts: DataFrame) -> DataFrame:
    """(surname, target): rare spellings and the spelling they are a slip of.

    ``support`` has surname and n, its distinct names, ``firsts`` surname and full first names.  A
    spelling of ``n`` names is rare beside a neighbour of ``n * n`` names or more: the share of slips
    falls as names grow, and no number is fixed.  One letter off, or two neighbours swapped, is a slip
    from ``ONE_EDIT`` letters; shorter spellings, two letters off from ``TWO_EDITS``, and two spellings of
    one name each, of which the first by letters is the target, must have a full first name in common.  Of several targets the one with most names counts, then the first by
    letters; a slip of a slip follows on, while it stays within the radius.
    """
    own = support.select(F.col("surname").alias("a"), F.col("n").alias("na")), support.select(F.col("surname").alias("b"), F.col("n").alias("nb"))
    both = pairs.join(own[0], "a").join(own[1], "b").filter("least(na, nb) * least(na, nb) <= greatest(na, nb)")
    rare = F.when(F.col("na") < F.col("nb"), F.struct(F.col("a").alias("surname"), F.col("b").alias("target"), F.col("nb").alias("n")))
    rare = rare.otherwise(F.struct(F.col("b").alias("surname"), F.col("a").alias("target"), F.col("na").alias("n")))
    shortest = F.least(F.length("a"), F.length("b"))
    swapped = F.pandas_udf(lambda a, b: pd.Series([N.within_one(x, y) for x, y in zip(a, b)], dtype=bool), "boolean")
    both = cut(both.select(rare.alias("r"), "edits", shortest.alias("shortest"), swapped("a", "b").alias("one")).select("r.*", "edits", "shortest", "one"))
    sure = both.filter(F.col("one") & (F.col("shortest") >= ONE_EDIT) & (F.col("n") > 1))
    asking = both.filter((F.col("one") & (F.col("shortest") > 2)) | (F.col("shortest") >= TWO_EDITS)).join(sure, ["surname", "target"], "left_anti").select(sure.columns)
    agreed = asking.join(firsts, "surname").join(firsts.select(F.col("surname").alias("target"), "first"), ["target", "first"]).select(sure.columns).distinct()
    # One edit before two: a target two letters off counts only where none is nearer.
    best = sure.withColumn("rank", F.lit(0)).unionByName(agreed.withColumn("rank", F.when(F.col("one"), 0).otherwise(1)))
    best = cut(best.groupBy("surname").agg(F.min_by("target", F.struct("rank", -F.col("n"), "target")).alias("target")))
    onward = best.select(F.col("surname").alias("target"), F.col("target").alias("further"))
    known = pairs.select(F.col("a").alias("surname"), F.col("b").alias("further")).unionByName(pairs.select(F.col("b").alias("surname"), F.col("a").alias("further"))).withColumn("near", F.lit(True))
    led = best.join(onward, "target", "left").join(known, ["surname", "further"], "left")
    return led.select("surname", F.when(F.col("near"), F.col("further")).otherwise(F.col("target")).alias("target"))


def _persons(rows: list[tuple[str, str, tuple[str, ...], int, bool]]) -> list[tuple[str, list[str], str]]:
    """Give each (surname, given) of one family and initial its person; rows: family, surname, given,
    names of the form, whether the form is at home under this initial.

    Names with a full first name found persons; shorter forms join the one person they can mean.
    The surnames of a family are spellings of one.
    """
    found: dict[tuple, tuple] = {}
    if not rows:
        return []
    family, members = rows[0][0], [r[1:] for r in rows]
    full = [m for m in members if m[1] and len(m[1][0]) > 1]
    short = [m for m in members if not (m[1] and len(m[1][0]) > 1)]
    weight = Counter()
    for _, given, n, _ in full:
        weight[given[0]] += n
    firsts: list[str] = []
    name_of: dict[str, str] = {}
    for first in sorted(weight, key=lambda f: (f in N.NICKNAMES, -weight[f], f)):
        near = [f for f in name_of if N.same_part(f, first)]
        head = min((name_of[f] for f in near), key=lambda f: (-weight[f], f), default=first)
        if head == first:
            firsts.append(first)
        elif first not in N.NICKNAMES:  # slips of one name may be two edits apart; they meet through it
            for f in near:
                if f in firsts and f != head and weight[f] <= 2:
                    firsts.remove(f)
                    for g in [g for g in name_of if name_of[g] == f]:
                        name_of[g] = head
        name_of[first] = head
    groups: dict[str, list] = defaultdict(list)
    for m in full:
        groups[name_of[m[1][0]]].append(m)
    persons: list[list] = []
    for first in firsts:
        mine: list[list] = []
        for m in sorted(groups[first], key=lambda m: (-len(m[1]), -m[2], m)):
            fits = [p for p in mine if N.compatible(p[0][1:], m[1][1:])]
            if len(fits) == 1 or (fits and len(m[1]) > 1):
                fits[0][1].append(m)
            elif not fits:
                mine.append([(first, *m[1][1:]), [m]])
        persons += mine
    for m in sorted((m for m in short if m[1]), key=lambda m: (-len(m[1]), -m[2], m)):
        fits = [p for p in persons if N.compatible(p[0], m[1])]
        exact = [p for p in fits if len(p[0]) >= len(m[1])] if len(fits) > 1 else fits
        if len(exact) == 1:
            exact[0][1].append(m)
        elif not fits:
            persons.append([m[1], [m]])
    for given, mine in persons:
        founder = min((m[0], m[1]) for m in mine)
        person = "\x00".join([family, *given[:1], *founder[1]])
        for m in mine:
            if m[3] and m[1]:
                found[m[0], m[1]] = (person,)
    return [(s, list(g), p[0]) for (s, g), p in found.items()]


def _by_family(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Persons of a partition sorted by family and initial, one such group at a time."""
    key, rows, out = None, [], []
    for batch in batches:
        for family, letter, surname, given, forms, home in zip(*(batch[c] for c in ("family", "letter", "surname", "given", "forms", "home"))):
            if (family, letter) != key:
                out += _persons(rows)
                key, rows = (family, letter), []
            rows.append((family, surname, tuple(given), int(forms), bool(home)))
        yield pd.DataFrame(out, columns=["surname", "given", "person"])
        out = []
    yield pd.DataFrame(_persons(rows), columns=["surname", "given", "person"])


def name_persons(found: DataFrame) -> DataFrame:
    """(name, person): the strings of ``found.name`` that name a known somebody, and whom.

    Strings that name nobody (null, empty, words for further authors) do not come out, nor does a
    form that could mean several persons.  Repeated rows count once; other columns are ignored.
    """
    parsed = parsed_names(found)
    bodies = parsed.filter("kind = 'body'").select("name", F.col("surname").alias("surname"))
    people = parsed.filter("kind = 'person'")
    forms = cut(people.groupBy("surname", "given").agg(F.count("*").alias("forms")))
    support = forms.groupBy("surname").agg(F.sum("forms").alias("n"))
    support = cut(support)
    every = support.select("surname").unionByName(bodies.select("surname"))
    pairs = cut(close_surnames(every))
    firsts = forms.filter("size(given) > 0 and length(given[0]) > 2").select("surname", F.get("given", F.lit(0)).alias("first")).distinct()
    slipped = cut(slips(pairs, support, firsts))
    # A surname that opens a double one stands for it where it is no slip itself; of several the one with most names.
    double = support.select(F.substring_index("surname", "-", 1).alias("head"), F.col("surname").alias("target"), "n").filter(f"head <> target and length(head) >= {ONE_EDIT}")
    double = double.join(support.select(F.col("surname").alias("head")), "head").join(slipped.select(F.col("surname").alias("head")), "head", "left_anti")
    double = double.groupBy("head").agg(F.min_by("target", F.struct(-F.col("n"), "target")).alias("target")).withColumnRenamed("head", "surname")
    onward = double.select(F.col("surname").alias("target"), F.col("target").alias("further"))
    led = slipped.unionByName(double).join(onward, "target", "left").select("surname", F.coalesce("further", "target").alias("family"))
    family = cut(support.select("surname").join(led, "surname", "left").select("surname", F.coalesce("family", "surname").alias("family")))

    base = forms.join(support, "surname").join(family, "surname")
    first = F.get("given", F.lit(0))
    short = F.create_map(*[F.lit(x) for pair in N.NICKNAMES.items() for x in pair])
    at = lambda c, i: F.substring(c, i, 1)
    letters = F.array_distinct(F.array(at(F.coalesce(short[first], first), 1), at(first, 1), F.when(F.length(first) > 2, at(first, 2)).otherwise(at(first, 1))))
    forms_at = base.filter("size(given) > 0").select("*", F.posexplode(letters).alias("at", "letter")).withColumn("home", F.col("at") == 0)
    forms_at = forms_at.select("family", "letter", "surname", "given", "forms", "home")
    forms_at = forms_at.repartition("family", "letter").sortWithinPartitions("family", "letter", "surname", "given")
    named = forms_at.mapInPandas(_by_family, "surname string, given array<string>, person string")
    named = cut(named)
    only = named.join(family, "surname").groupBy("family").agg(F.min("person").alias("low"), F.max("person").alias("high")).filter("low = high")
    alone = base.filter("size(given) = 0").select("surname", "given", "family").join(only, "family").select("surname", "given", F.col("low").alias("person"))
    persons = named.unionByName(alone)
    return people.join(persons, ["surname", "given"]).select("name", "person").unionByName(_bodies(bodies, pairs))


def _bodies(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Collaborations: a rare spelling one slip off counts as its neighbour."""
    support = bodies.groupBy("surname").agg(F.count("*").alias("n"))
    none = bodies.select("surname", F.lit("").alias("first")).limit(0)
    target = slips(pairs, support, none)
    return bodies.join(target, "surname", "left").select("name", F.concat(F.lit("body\x00"), F.coalesce("target", "surname")).alias("person"))


def name_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: different strings that name the same somebody."""
    persons = cut(name_persons(found).distinct())
    a, b = persons.alias("a"), persons.alias("b")
    return a.join(b, (F.col("a.person") == F.col("b.person")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
