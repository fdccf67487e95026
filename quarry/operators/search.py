"""Phrase, pattern and ranked search over blocks and documents."""

from __future__ import annotations

import difflib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import text as T
from quarry.operators import address as A

MIN_BACKOFF = 3
MIN_COVERAGE = 0.34
SENTENCE = 300
PHRASE_WORDS = 6
EXACT_TITLE, APPROXIMATE_TITLE = 0.95, 0.6
#: Titles meet on runs of so many signs, counted in so many slots; numbers of blanks, digits and letters; room for rounding.
GRAM, SLOTS, SLACK = 5, 131071, 1e-6
SIGNS = np.zeros(256, dtype=np.int64)
SIGNS[[ord(x) for x in "0123456789abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 37)


def flat(blocks: DataFrame) -> DataFrame:
    """Blocks with something to read, with ``flat``: their words as phrases are searched in them."""
    return blocks.withColumn("flat", T.flatten(T.words_of_block())).filter("flat <> ''")


def _clipped(sentence: Column, before: Column, size: Column) -> Column:
    """A sentence of at most ``SENTENCE`` characters around a match that begins after ``before`` of them."""
    length = F.length(sentence)
    left = F.greatest(F.lit(0), before - F.floor(F.greatest(SENTENCE - size, F.lit(0)) / 2))
    right = F.least(length, left + SENTENCE)
    left = F.greatest(F.lit(0), right - SENTENCE).cast("int")
    piece = F.substring(sentence, left + 1, (right - left).cast("int"))
    piece = F.when(left > 0, F.concat(F.lit("…"), F.substring(piece, 2, SENTENCE))).otherwise(piece)
    piece = F.when(right < length, F.concat(F.substring(piece, F.lit(1), F.length(piece) - 1), F.lit("…"))).otherwise(piece)
    return F.trim(F.when(length <= SENTENCE, sentence).otherwise(piece))


def phrase_search(blocks: DataFrame, phrase: str, case_sensitive: bool = False) -> DataFrame:
    """One row for each match of a phrase: its address, place, sentence and the neighbours of its block.

    Phrase and block are flattened alike, so line breaks, odd blanks and curly quotes don't hide a
    match.  Blocks are filtered first; only the chapters that hold a hit are walked for neighbours,
    and of those only the narrow columns.  A match over the end of a sentence keeps all it touches.
    """
    wanted = " ".join(phrase.translate(str.maketrans(T.QUOTES_FROM, T.QUOTES_TO)).split())
    fold = (lambda c: c) if case_sensitive else F.lower
    needle = wanted if case_sensitive else wanted.lower()
    size = len(needle)
    hits = flat(blocks).filter(F.contains(fold(F.col("flat")), F.lit(needle))).select("slug", "stem", "idx", "kind", "anchor", "flat")
    narrow = blocks.select("slug", "stem", "idx", "kind", "level", "anchor").join(hits.select("slug", "stem").distinct(), ["slug", "stem"], "left_semi")
    near = A.neighbours(narrow).select("slug", "stem", "idx", "prev", "next", "parent")
    pieces = F.split(fold(F.col("flat")), f"\\Q{needle}\\E", -1)
    none = F.expr("cast(array() as array<int>)")
    starts = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), none, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1 - size)) + size + F.length(x))))
    rows = hits.select("*", T.sentence_marks("flat").alias("marked"), F.posexplode(starts).alias("match", "at"))
    before = F.length(F.element_at(F.split(F.substring("marked", F.lit(1), F.col("at") - 1), "\x02", -1), -1))
    after = F.length(F.element_at(F.split(F.expr(f"substring(marked, at + {size})"), "\x02", -1), 1))
    sentence = F.substring("flat", F.col("at") - before, before + size + after)
    rows = rows.withColumn("sentence", _clipped(sentence, before, F.lit(size))).join(near, ["slug", "stem", "idx"])
    return rows.select("slug", "stem", F.col("idx").cast("long").alias("idx"), F.col("match").cast("long").alias("match"), "kind", T.location().alias("location"), "sentence", "prev", "next", "parent")


def pattern_search(blocks: DataFrame, pattern: str) -> DataFrame:
    """One row for each match of a regular expression: (slug, stem, idx, match)."""
    found = flat(blocks).select("slug", "stem", F.col("idx").cast("long").alias("idx"), F.regexp_extract_all("flat", F.lit(f"(?i){pattern}"), F.lit(0)).alias("all"))
    return found.select("slug", "stem", "idx", F.explode("all").alias("match"))


def phrase_backoff(blocks: DataFrame, phrase: str) -> DataFrame:
    """The longest beginning of a phrase, of at least three words, that has hits: (words, phrase, hits); one job."""
    words = phrase.lower().split()
    tries = [" ".join(words[:n]) for n in range(len(words), MIN_BACKOFF - 1, -1)]
    texts = flat(blocks).select(F.lower("flat").alias("flat"))
    counts = texts.agg(*[F.count_if(F.contains("flat", F.lit(t))).alias(f"n{i}") for i, t in enumerate(tries)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(len(t.split())).cast("long").alias("words"), F.lit(t).alias("phrase"), F.col(f"n{i}").alias("hits")) for i, t in enumerate(tries)])).alias("r")).select("r.*")
    return rows.filter("hits > 0").orderBy(F.col("words").desc()).limit(1)


def prefix_matches(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, word): equal words, and words of which one begins with the other, the shorter having four letters.

    Every such pair is equal or shares its first four letters, so the join is an equi-join on them.
    """
    block = lambda c: F.substring(c, 1, T.MIN_PREFIX)
    left, right = terms.select("term", block("term").alias("k")), words.select("word", block("word").alias("k"))
    fits = (F.col("term") == F.col("word")) | ((F.least(F.length("term"), F.length("word")) >= T.MIN_PREFIX) & (F.startswith("term", F.col("word")) | F.startswith("word", F.col("term"))))
    return left.join(right, "k").filter(fits).select("term", "word")


def _topic_hits(documents: DataFrame, topic: str) -> tuple[list[str], DataFrame]:
    """Topic terms and (key, got): which of them each document (key, words) holds; within the row, without a join."""
    terms = T.topic_list(topic)
    return terms, documents.select("key", T.held_terms("words", terms).alias("got"))


def term_weights(documents: DataFrame, topic: str) -> DataFrame:
    """(term, df, weight): in how many documents (key, words) each topic term occurs, and ln(1 + N / df).

    One pass with a counter for each of the at most ``MAX_TERMS`` terms.
    """
    terms, hits = _topic_hits(documents, topic)
    counts = hits.agg(F.count("*").alias("whole"), *[F.count_if(F.array_contains("got", t)).alias(f"n{i}") for i, t in enumerate(terms)])
    rows = [F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("df"), F.col("whole")) for i, t in enumerate(terms)]
    every = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else counts.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("df"), "whole").limit(0)
    return every.select("term", "df", F.log(1 + F.greatest("whole", F.lit(1)) / F.greatest("df", F.lit(1))).alias("weight"))


def coverage(documents: DataFrame, topic: str, limit: int = 300) -> DataFrame:
    """(key, coverage, missing): documents by the weighted share of topic terms they hold, the best ``limit``.

    Rare terms weigh more.  ``missing`` names the absent terms in topic order.  Documents below
    ``MIN_COVERAGE`` are left out before a costlier scorer would see them.
    """
    terms, hits = _topic_hits(documents, topic)
    weights = {r["term"]: r["weight"] for r in term_weights(documents, topic).collect()}  # one row for each topic term, at most 12
    whole = sum(weights.values()) or 1.0
    share = sum((F.when(F.array_contains("got", t), F.lit(w)).otherwise(F.lit(0.0)) for t, w in weights.items()), F.lit(0.0)) / whole
    missing = F.filter(T.strings(terms), lambda t: ~F.array_contains(F.col("got"), t))
    return hits.select("key", share.alias("coverage"), missing.alias("missing")).filter(F.col("coverage") >= MIN_COVERAGE).orderBy(F.desc("coverage"), "key").limit(limit)


def ladder(documents: DataFrame, topic: str) -> DataFrame:
    """(key, rung): documents (key, title, words) by the first query of a ladder that finds them.

    The rungs are strict (every topic term), phrase (the topic's first words in the title) and broad
    (any term); a document of an earlier rung does not come again, so one pass tells its rung.
    """
    terms = T.topic_list(topic)
    words = F.array(F.split(T.normalize_title("words"), " "))
    held = F.get(F.transform(words, lambda ws: F.size(F.filter(T.strings(terms), lambda t: F.array_contains(ws, t)))), F.lit(0))
    phrase = F.contains(T.normalize_title("title"), F.lit(" ".join(topic.lower().split()[:PHRASE_WORDS])))
    rung = F.when(held == len(terms), "strict").when(phrase, "phrase").when(held > 0, "broad")
    return documents.select("key", rung.alias("rung")).filter("rung is not null")


def resort(rows: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """Order by a column, largest first and unknown last, ties by relevance rank; where all are unknown that rank decides."""
    order = [F.col(rank)] if by == "relevance" else [F.col(by).desc_nulls_last(), F.col(rank)]
    return rows.orderBy(*order)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, for which there is no built-in; meant for blocked candidates only."""
    ratio = lambda x, y: pd.Series([difflib.SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y)], dtype="float64")
    return pandas_udf(ratio, "double")(a, b)


def _letter_bits(t: Column) -> list[Column]:
    """How often a normal title holds each sign, as runs of bits: differing bits are a lower bound of differing signs."""
    def run(sign: str, most: int) -> Column:
        held = F.least(F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit(""))), F.lit(most))
        return F.call_function("shiftleft", F.lit(1).cast("long"), held) - 1

    groups = (("etaoinsr", 8), ("lcdumhpg", 8), ("fbvywkjqxz0123456789 ", 3))
    return [reduce(lambda a, x: a.bitwiseOR(x), [F.shiftleft(run(sign, most), most * i) for i, sign in enumerate(signs)]) for signs, most in groups]


def _grams(titles: pd.Series, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and number of every run of ``q`` signs in normal titles."""
    signs = np.frombuffer("".join(titles).encode("ascii"), dtype=np.uint8)
    codes = SIGNS[signs]
    lengths = titles.str.len().to_numpy(dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(signs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = np.flatnonzero(at <= lengths[rows] - q)
    return rows[kept], at[kept], sum((codes[kept + i] * 37 ** (q - 1 - i) for i in range(q)), np.zeros(len(kept), dtype=np.int64))


def _gram_counts(titles: DataFrame, q: int) -> np.ndarray:
    """How common runs of ``q`` signs are, in ``SLOTS`` slots: all that comes to the driver."""

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_grams(batch["t"], q)[2] % SLOTS, minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slots, "n": total[slots]})

    counts = np.zeros(SLOTS, dtype=np.int64)
    found = titles.select("t").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[found["slot"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def _rare_grams(titles: DataFrame, q: int, lost: float, counts: np.ndarray) -> DataFrame:
    """(g, p, l, s0, s1, s2): for each title its rarest runs of ``q`` signs, one more than edits can break."""

    def rare(batches):
        for batch in batches:
            rows, at, grams = _grams(batch["t"], q)
            order = np.lexsort((at, grams, counts[grams % SLOTS], rows))
            rows, at, grams = rows[order], at[order], grams[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = rank <= np.floor(q * lost * batch["l"].to_numpy()[rows] + SLACK)
            yield batch.iloc[rows[kept]].drop(columns="t").assign(g=grams[kept], p=at[kept])[["g", "p", "l", "s0", "s1", "s2"]]

    return titles.mapInPandas(rare, "g int, p int, l int, s0 long, s1 long, s2 long")


def _close_titles(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(t, u): every asked title ``t`` and held title ``u`` that differ and may be alike by ``least``, and a few others.

    Of a ratio of ``least`` at most a share of 1 - ``least`` of both titles' signs is left out or put in.
    Each such edit breaks at most ``q`` runs of ``q`` signs, so two titles share a run among their rarest,
    one more than the edits can break, at places that the edits can shift to each other.  Which runs are
    rarest only decides how many pairs meet.  Places are told in quarters of a class of lengths.
    A title goes by its bits meanwhile; all titles of the same bits come back for them.
    """
    gone = 1 - least
    lost, most = 2 * gone / (1 + gone), 2 * gone / (1 - gone)
    shortest = math.ceil(1 / most - SLACK)
    q = max((n for n in range(1, GRAM + 1) if shortest * (1 - n * lost) >= n), default=0)
    edits = F.floor((F.col("l") + F.col("m")) * gone + SLACK).cast("int")
    if not q:
        return asked.crossJoin(held.withColumnRenamed("t", "u")).filter("t <> u")

    def marked(titles):
        bits = [x.alias(f"s{i}") for i, x in enumerate(_letter_bits(F.col("t")))]
        return titles.filter(F.length("t") >= shortest).select("t", F.length("t").alias("l"), *bits)

    asked, held = marked(asked), marked(held)
    counts = _gram_counts(asked.select("t").unionAll(held.select("t")), q)
    size = lambda l: F.floor(F.log(l) / math.log(1.25)).cast("int")
    part = lambda p: F.floor(p / (F.pow(F.lit(1.25), F.col("c")) / 4)).cast("int")
    far = F.floor(F.col("l") * most + SLACK).cast("int")
    left = _rare_grams(asked, q, lost, counts).withColumn("c", F.explode(F.sequence(size(F.col("l") - far), size(F.col("l") + far))))
    left = left.withColumn("a", F.explode(F.sequence(part(F.col("p") - far), part(F.col("p") + far))))
    right = _rare_grams(held, q, lost, counts).withColumn("c", size(F.col("l"))).withColumn("a", part(F.col("p")))
    right = right.select("g", "c", "a", F.col("p").alias("o"), F.col("l").alias("m"), *[F.col(f"s{i}").alias(f"r{i}") for i in range(3)])
    shifted = F.abs(F.col("p") - F.col("o")) + F.abs(F.col("l") - F.col("p") - F.col("m") + F.col("o"))
    differing = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(3)), F.lit(0))
    met = left.join(right, ["g", "c", "a"]).filter((shifted <= edits) & (differing <= edits)).select(*[f"{x}{i}" for x in "sr" for i in range(3)]).distinct()
    pairs = met.join(asked, ["s0", "s1", "s2"]).join(held.select(F.col("t").alias("u"), F.col("l").alias("m"), *[F.col(f"s{i}").alias(f"r{i}") for i in range(3)]), ["r0", "r1", "r2"])
    return pairs.withColumn("edits", edits).filter("levenshtein(t, u, edits) >= 0").select("t", "u")


def title_hits(wanted: DataFrame, works: DataFrame, least: float = EXACT_TITLE) -> DataFrame:
    """(key, work_id, score): stored works whose title is almost the wanted one's (key, title).

    Every pair of titles with a score of ``least`` is found, as if all were compared.  The best score
    wins, ties the smaller id; an equal title scores 1, so nothing else is asked about it.
    """
    left = wanted.select("key", T.normalize_title("title").alias("t")).filter("t <> ''")
    right = works.select("work_id", T.normalize_title("title").alias("u")).filter("u <> ''").groupBy("u").agg(F.min("work_id").alias("work_id"))
    held = right.select(F.col("u").alias("t"))
    asked = left.select("t").distinct()
    equal = right.select(F.col("u").alias("t"), F.struct("work_id", F.lit(1.0).alias("score")).alias("b"))
    pairs = _close_titles(asked.join(held, "t", "left_anti"), held, least)
    scored = pairs.withColumn("score", sequence_ratio(F.col("t"), F.col("u"))).filter(F.col("score") >= least).join(right, "u")
    best = scored.groupBy("t").agg(F.max_by(F.struct("work_id", "score"), F.struct("score", -F.col("work_id"))).alias("b"))
    return left.join(equal.unionByName(best), "t").select("key", "b.work_id", "b.score")


def named_paper(works: DataFrame, title: str = "", author: str = "", year: int | None = None, most: int = 15) -> DataFrame:
    """(work_id, score, match): how well stored works answer to a title, an author and a year that a person gave.

    With a title the score is the likeness of titles or the share of its words that the other holds,
    and 0.02 for the author and the year each; without, the share of what agrees.  A year agrees with
    the one before too.  ``match`` is exact if all agrees, approximate from a likeness of
    ``APPROXIMATE_TITLE``, else none; the best ``most``, ties by id.
    """
    spark = works.sparkSession
    asked = spark.range(1).select(T.normalize_title(F.lit(title)).alias("t"), T.normalize_title(T.surname(F.lit(author))).alias("a")).first()
    own = T.normalize_title("title")
    rows = works.select("work_id", own.alias("u"), F.coalesce("authors", F.expr("cast(array() as array<string>)")).alias("authors"), "year")
    checks: dict[str, Column] = {}
    if title:
        rows = rows.withColumn("ratio", sequence_ratio(F.lit(asked.t), F.col("u")))
        checks["title"] = F.col("ratio") >= EXACT_TITLE
        words = asked.t.split()
        held = sum((F.array_contains(F.split("u", " "), w).cast("int") for w in words), F.lit(0)) / max(1, len(words))
        rows = rows.withColumn("likeness", F.greatest("ratio", held))
    if author:
        checks["author"] = F.exists("authors", lambda x: F.contains(T.normalize_title(T.surname(x)), F.lit(asked.a))) & F.lit(bool(asked.a))
    if year:
        checks["year"] = F.coalesce(F.col("year").isin(year, year - 1), F.lit(False))
    agreed = [F.coalesce(c, F.lit(False)) for c in checks.values()]
    share = sum((c.cast("int") for c in agreed), F.lit(0)) / max(1, len(agreed))
    bonus = sum((F.when(F.coalesce(checks[k], F.lit(False)), 0.02).otherwise(0.0) for k in ("author", "year") if k in checks), F.lit(0.0))
    score = F.least(F.lit(1.0), F.col("likeness") + bonus) if title else share
    close = F.col("likeness") >= APPROXIMATE_TITLE if title else share > 0
    every = agreed[0] if agreed else F.lit(False)
    for c in agreed[1:]:
        every = every & c
    match = F.when(every, "exact").when(close, "approximate").otherwise("none")
    return rows.select("work_id", score.cast("double").alias("score"), match.alias("match")).orderBy(F.desc("score"), "work_id").limit(most)


def scored(documents: DataFrame, topic: str, score=None, limit: int = 300) -> DataFrame:
    """(key, score, ranked): documents (key, words) best first, the ``limit`` candidates of coverage scored by a model if there is one.

    ``score`` maps (topic, texts as a Series) to numbers and runs on Arrow batches; without one, or for
    texts it gives no number for, coverage stands in and such rows come after all scored ones.
    """
    found = coverage(documents, topic, limit)
    if score is None:
        return found.select("key", F.col("coverage").alias("score"), F.lit(False).alias("ranked"))
    run = pandas_udf(lambda texts: pd.Series(score(topic, texts), dtype="float64"), "double")
    rows = found.join(documents, "key").withColumn("model", run(F.coalesce("words", F.lit(""))))
    ranked = F.col("model").isNotNull() & ~F.isnan("model")
    return rows.select("key", F.when(ranked, F.col("model")).otherwise(F.col("coverage")).alias("score"), ranked.alias("ranked")).orderBy(F.desc("ranked"), F.desc("score"), "key")
