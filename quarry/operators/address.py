"""Addresses of blocks: scopes, spans, neighbours, contexts, contents and caps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Levels of headings that are told apart; deeper ones count as the last of them.
LEVELS = range(1, 11)
SHOWN = 5
SCOPE = re.compile(r"^(?P<slug>[^/#\s.]+(?:\.[^/#\s.]+)*)(?:/(?P<stem>[^/#\s.]+(?:\.[^/#\s.]+)*))?(?:#(?P<start>[^#\s.]+(?:\.[^#\s.]+)*))?(?:\.\.(?:#?(?P<end>[^#\s]+)))?$")


@dataclass(frozen=True)
class Scope:
    """A part of the collection: everything, a paper, a chapter, a section, or a span between two anchors."""

    slug: str = ""
    stem: str = ""
    anchor: str = ""
    until: str = ""


def parse_scope(token: str) -> Scope:
    """``disk``, ``slug``, ``slug/stem``, ``slug#a``, ``slug/stem#a``, ``slug/stem#a..#b``; else ValueError."""
    if token.strip() == "disk":
        return Scope()
    found = SCOPE.match(token.strip())
    if not found or (found["end"] and not found["start"]):
        raise ValueError(f"not a scope: {token!r}")
    return Scope(found["slug"], found["stem"] or "", found["start"] or "", found["end"] or "")


def depth() -> Column:
    return F.least(F.coalesce("level", F.lit(0)), F.lit(LEVELS[-1]))


def chapter() -> Window:
    return Window.partitionBy("slug", "stem").orderBy("idx")


ABOVE = (Window.unboundedPreceding, -1)
BELOW = (1, Window.unboundedFollowing)


def spans(blocks: DataFrame) -> DataFrame:
    """Add ``span_end``: a heading reaches to the next heading of its level or a higher one, others to themselves.

    One pass over each chapter: for every level the next heading below is looked up, so a long
    chapter is never joined with itself.  A missing level counts as 0.
    """
    level, heading = depth(), F.col("kind") == "heading"
    below = chapter().rowsBetween(*BELOW)
    nexts = [F.when(level >= k, F.first(F.when(heading & (level == k), F.col("idx")), ignorenulls=True).over(below)) for k in (0, *LEVELS)]
    last = F.max("idx").over(Window.partitionBy("slug", "stem")) + 1
    return blocks.withColumn("span_end", F.when(heading, F.coalesce(F.least(*nexts), last)).otherwise(F.col("idx") + 1).cast("long"))


class ScopeError(ValueError):
    """A scope that names nothing or more than one thing; ``args[1]`` holds what it could mean."""


def resolve(blocks: DataFrame, scopes: list[Scope]) -> DataFrame:
    """(slug, stem, start, end): the ranges that scopes name; several in one chapter give their hull.

    Scopes are a short list given by a person, so each is a filter of its own and every filter reaches
    the scan.  A missing end means the end of the chapter, an anchor that is not there names nothing.
    """
    parts = []
    for s in scopes:
        held = blocks
        for name, value in (("slug", s.slug), ("stem", s.stem)):
            held = held.filter(F.col(name) == value) if value else held
        known = spans(held).select("slug", "stem", "idx", "anchor", "span_end")
        parts.append(known.filter(F.col("anchor").isin([a for a in (s.anchor, s.until) if a])) if s.anchor else known)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("slug", "stem").agg(F.min("idx").cast("long").alias("start"), F.max("span_end").cast("long").alias("end"))


def refused(blocks: DataFrame, scopes: list[Scope]) -> DataFrame:
    """(scope, reason, candidates): scopes that cannot be read and the chapters they could mean, at most ``SHOWN``.

    Reasons are, in this order: no such paper, no such chapter, no such anchor, ambiguous anchor.
    """
    spark = blocks.sparkSession
    asked = spark.createDataFrame([(i, f"{s.slug}/{s.stem}#{s.anchor}", s.slug, s.stem, s.anchor) for i, s in enumerate(scopes)], "n int, scope string, a_slug string, a_stem string, a_anchor string").filter("a_slug <> ''")
    asked = F.broadcast(asked)  # a short list given by a person
    stems = blocks.join(asked.select(F.col("a_slug").alias("slug")), "slug", "left_semi").select("slug", "stem", _anchor().alias("anchor")).distinct()
    hits = asked.join(stems, asked["a_slug"] == stems["slug"], "left")
    here = (F.col("a_stem") == "") | (F.col("stem") == F.col("a_stem"))
    carrying = here & (F.col("anchor") == F.col("a_anchor"))
    counted = hits.groupBy("n", "scope", "a_stem", "a_anchor").agg(
        F.count("slug").alias("paper"), F.count_if(here & F.col("slug").isNotNull()).alias("chapter"), F.count_distinct(F.when(carrying, F.col("stem"))).alias("stems"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(carrying, F.col("stem")))), 1, SHOWN), ",").alias("candidates"))
    reason = F.when(F.col("paper") == 0, "no such paper").when(F.col("chapter") == 0, "no such chapter")
    reason = reason.when((F.col("a_anchor") != "") & (F.col("stems") == 0), "no such anchor").when((F.col("a_anchor") != "") & (F.col("stems") > 1), "ambiguous anchor")
    return counted.withColumn("reason", reason).filter("reason is not null").select("scope", "reason", "candidates")


def checked(blocks: DataFrame, scopes: list[Scope]) -> DataFrame:
    """resolve(), or ScopeError where a scope names nothing or more than one thing."""
    wrong = refused(blocks, scopes).limit(len(scopes)).collect()
    if wrong:
        raise ScopeError("; ".join(f"{r.scope}: {r.reason}" for r in wrong), [(r.scope, r.reason, r.candidates) for r in wrong])
    return resolve(blocks, scopes)


def papers_in(known: DataFrame, scopes: list[Scope]) -> DataFrame:
    """(slug): papers that scopes of whole papers name; ``disk`` stands for all.  Chapters, anchors and unknown papers are refused."""
    if any(s.stem or s.anchor for s in scopes):
        raise ScopeError("a paper or disk is wanted, not a chapter or an anchor", [s for s in scopes if s.stem or s.anchor])
    if any(not s.slug for s in scopes):
        return known.select("slug").distinct()
    wanted = sorted({s.slug for s in scopes})
    held = known.filter(F.col("slug").isin(wanted)).select("slug").distinct()
    missing = set(wanted) - {r.slug for r in held.collect()}
    if missing:
        raise ScopeError("no such paper in the collection", sorted(missing))
    return held


def described(ranges: DataFrame) -> DataFrame:
    """(papers, chapters, blocks) of resolved ranges."""
    return ranges.agg(F.count_distinct("slug").alias("papers"), F.count("*").alias("chapters"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("blocks"))


def ambiguous(blocks: DataFrame) -> DataFrame:
    """(slug, anchor, chapters, stems): anchors that stand in several chapters of a paper, with the first ``SHOWN`` of them."""
    named = blocks.filter("coalesce(anchor, '') <> ''").select("slug", "anchor", "stem").distinct()
    rank = F.row_number().over(Window.partitionBy("slug", "anchor").orderBy("stem"))
    counted = named.groupBy("slug", "anchor").agg(F.count("*").alias("chapters")).filter("chapters > 1")
    shown = named.withColumn("rn", rank).filter(F.col("rn") <= SHOWN).groupBy("slug", "anchor").agg(F.sort_array(F.collect_list("stem")).alias("stems"))
    return counted.join(shown, ["slug", "anchor"])


def _anchor() -> Column:
    return F.when(F.coalesce("anchor", F.lit("")) != "", F.col("anchor"))


def parent() -> Column:
    """Anchor of the nearest heading above that has one; above a heading, the nearest of strictly lower level."""
    above, level = chapter().rowsBetween(*ABOVE), depth()
    heading = F.col("kind") == "heading"
    mine = F.when(heading, level).otherwise(F.lit(99))
    known = [F.when(mine > k, F.last(F.when(heading & (level == k) & _anchor().isNotNull(), F.struct("idx", "anchor")), ignorenulls=True).over(above)) for k in (0, *LEVELS)]
    return F.greatest(*known)["anchor"]


def neighbours(blocks: DataFrame) -> DataFrame:
    """Add ``prev``, ``next`` and ``parent``: anchors of the nearest addressable blocks and heading."""
    prev = F.last(_anchor(), ignorenulls=True).over(chapter().rowsBetween(*ABOVE))
    following = F.first(_anchor(), ignorenulls=True).over(chapter().rowsBetween(*BELOW))
    return blocks.withColumn("prev", prev).withColumn("next", following).withColumn("parent", parent())


def context(blocks: DataFrame, hit: Column, width: int = 1) -> DataFrame:
    """Blocks within ``width`` of a block where ``hit`` holds, in the same chapter."""
    near = F.max(F.when(hit, 1).otherwise(0)).over(chapter().rowsBetween(-width, width))
    return blocks.withColumn("near", near).filter("near = 1").drop("near")


def contents(blocks: DataFrame, deepest: int = 2) -> DataFrame:
    """Headings with rank, words of their section and whether a deeper heading follows.

    The rank counts the levels that the chapter uses, so chapters may skip levels.  A section's words
    are the difference of running sums at its heading and at the one that ends it, which is looked up
    in the same pass over the chapter.
    """
    level, heading = depth(), F.col("kind") == "heading"
    counted = blocks.select("slug", "stem", "idx", "kind", "level", "anchor", "title", T.word_count(T.words_of_block()).alias("words"))
    counted = counted.withColumn("before", F.coalesce(F.sum("words").over(chapter().rowsBetween(*ABOVE)), F.lit(0)))
    below = chapter().rowsBetween(*BELOW)
    nexts = [F.when(level >= k, F.first(F.when(heading & (level == k), F.struct("idx", "before")), ignorenulls=True).over(below)) for k in (0, *LEVELS)]
    own = Window.partitionBy("slug", "stem")
    heads = counted.withColumn("until", F.coalesce(F.least(*nexts)["before"], F.sum("words").over(own))).filter(heading)
    heads = heads.withColumn("rank", F.dense_rank().over(own.orderBy(F.coalesce("level", F.lit(0)))).cast("long"))
    heads = heads.withColumn("deeper", F.max("rank").over(own) > deepest).filter(F.col("rank") <= deepest)
    return heads.select("slug", "stem", F.col("idx").cast("long").alias("idx"), "anchor", "title", "rank", (F.col("until") - F.col("before")).alias("section_words"), "deeper")


def capped(rows: DataFrame, partition: list[str], order: list[Column], words: str, limit: int, most: int) -> DataFrame:
    """The first rows of each partition: at most ``limit``, and no more than ``most`` words, but always one."""
    window = Window.partitionBy(*partition).orderBy(*order)
    running = F.sum(words).over(window.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("rn", F.row_number().over(window)).withColumn("running", running)
    return placed.withColumn("kept", (F.col("rn") <= limit) & ((F.col("rn") == 1) | (F.col("running") <= most)))


def paper_caps(rows: DataFrame, words: str, limit: int, most: int) -> DataFrame:
    """capped() over whole papers (slug, stem, idx): chapters are counted on their own and laid end to end, so no task orders a paper."""
    totals = rows.groupBy("slug", "stem").agg(F.count("*").alias("n"), F.sum(words).alias("w"))
    before = Window.partitionBy("slug").orderBy("stem").rowsBetween(*ABOVE)
    starts = totals.select("slug", "stem", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w"))
    running = chapter().rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("own", F.row_number().over(chapter())).withColumn("sum", F.sum(words).over(running))
    placed = own.join(starts, ["slug", "stem"]).withColumn("rn", F.col("n") + F.col("own")).withColumn("running", F.col("w") + F.col("sum")).drop("own", "sum", "n", "w")
    return placed.withColumn("kept", (F.col("rn") <= limit) & ((F.col("rn") == 1) | (F.col("running") <= most)))


def paragraph_anchors(blocks: DataFrame, least: int = 80) -> DataFrame:
    """Add ``address``: a block's own anchor, else ``pN`` for paragraphs of ``least`` characters and ``bN`` for all others.

    Only blocks without an anchor are counted, each kind from 1 in every chapter.
    """
    bare = _anchor().isNull()
    long = bare & (F.col("kind") == "paragraph") & (F.length(F.coalesce("text", F.lit(""))) >= least)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(chapter().rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.when(long, F.concat(F.lit("p"), count(long))).otherwise(F.concat(F.lit("b"), count(bare & ~long)))
    return blocks.withColumn("address", F.coalesce(_anchor(), fresh))


def object_numbers(blocks: DataFrame) -> DataFrame:
    """Running numbers of figures, tables and formulas through a paper, chapter by chapter.

    Numbers are counted within chapters and chapters laid end to end, so no task orders a whole paper.
    """
    kinds = blocks.filter(F.col("kind").isin("figure", "table", "math"))
    own = F.row_number().over(Window.partitionBy("slug", "stem", "kind").orderBy("idx"))
    before = Window.partitionBy("slug", "kind").orderBy("stem").rowsBetween(*ABOVE)
    starts = kinds.groupBy("slug", "stem", "kind").agg(F.count("*").alias("n")).select("slug", "stem", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = kinds.withColumn("own", own).join(starts, ["slug", "stem", "kind"])
    return placed.withColumn("object_number", (F.col("start") + F.col("own")).cast("long")).drop("start", "own")


def heading_numbers(blocks: DataFrame) -> DataFrame:
    """Numbers of sections and subsections, ``c.s`` and ``c.s.t``: c counts chapters, s starts again in each, t after each s.

    The shallowest level below the chapter's own, 1, is a section, all deeper ones are subsections.
    """
    deep = F.coalesce("level", F.lit(0))
    heads = blocks.filter(F.col("kind") == "heading").withColumn("deep", deep)
    stems = heads.select("slug", "stem").distinct().withColumn("c", F.row_number().over(Window.partitionBy("slug").orderBy("stem")))
    running = chapter().rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.filter("deep > 1").withColumn("s", F.sum(F.when(F.col("deep") == 2, 1).otherwise(0)).over(running))
    inner = Window.partitionBy("slug", "stem", "s").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.withColumn("t", F.sum(F.when(F.col("deep") > 2, 1).otherwise(0)).over(inner)).join(stems, ["slug", "stem"])
    dotted = F.concat_ws(".", F.col("c").cast("string"), F.col("s").cast("string"), F.when(F.col("deep") > 2, F.col("t").cast("string")))
    return heads.withColumn("dotted", dotted)


def sections(blocks: DataFrame) -> DataFrame:
    """Rows between consecutive headings as one section: (slug, stem, section, first, last, blocks, words)."""
    started = F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(chapter().rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.withColumn("section", started.cast("long")).withColumn("words", T.word_count(T.words_of_block()))
    return marked.groupBy("slug", "stem", "section").agg(F.min("idx").cast("long").alias("first"), F.max("idx").cast("long").alias("last"), F.count("*").alias("blocks"), F.sum("words").alias("words"))


def suffixes(rows: DataFrame, base: str, order: list[Column], first: str = "_b") -> DataFrame:
    """Unique names: the first of each base keeps it, later ones get _b, _c, ..., past _z the count."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    tail = F.when(n == 1, F.lit("")).when(n <= 26, F.concat(F.lit("_"), F.char(96 + n))).otherwise(F.concat(F.lit("_"), n.cast("string")))
    return rows.withColumn("unique_name", F.concat(F.col(base), tail))
