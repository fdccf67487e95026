"""Audits of citations, references, held papers and report markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

SHOWN = 5


def cited_tags(blocks: DataFrame) -> DataFrame:
    """(slug, stem, tag): every tag that a block's markers name, once for each chapter."""
    return blocks.select("slug", "stem", F.explode(T.cite_tags("text")).alias("tag")).distinct()


def unresolved(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """(tag, chapters, files): cited tags without a record, with the first ``SHOWN`` chapters that cite them."""
    missing = cited_tags(blocks).join(store.select("tag").distinct(), "tag", "left_anti")
    files = missing.select("tag", F.concat_ws("/", "slug", "stem").alias("file")).distinct()
    first = files.withColumn("rn", F.row_number().over(Window.partitionBy("tag").orderBy("file"))).filter(F.col("rn") <= SHOWN)
    return files.groupBy("tag").agg(F.count("*").alias("chapters")).join(first.groupBy("tag").agg(F.sort_array(F.collect_list("file")).alias("files")), "tag")


def stale_held(store: DataFrame, papers: DataFrame) -> DataFrame:
    """(work_id, held_as): works said to be held as a paper that is not there."""
    return store.filter("coalesce(held_as, '') <> ''").select("work_id", F.col("held_as")).join(papers.select(F.col("slug").alias("held_as")), "held_as", "left_anti").select("work_id", "held_as")


def references(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """(slug, label, uses, reason): cross references by label and why they dangle, '' where they do not.

    A label is known if the paper's manifest has it by name or anchor; else it may be an anchor of
    a block; else it is unknown, or the paper itself is.
    """
    used = blocks.select("slug", F.explode(T.ref_labels("text")).alias("label")).groupBy("slug", "label").agg(F.count("*").alias("uses"))
    labels = papers.select("slug", F.explode("labels").alias("name", "value"))
    known = labels.select("slug", F.col("name").alias("label")).unionByName(labels.select("slug", F.col("value.anchor").alias("label"))).distinct().withColumn("by_label", F.lit(True))
    anchors = blocks.filter("coalesce(anchor, '') <> ''").select("slug", F.col("anchor").alias("label")).distinct().withColumn("by_anchor", F.lit(True))
    held = papers.select("slug").withColumn("held", F.lit(True))
    rows = used.join(held, "slug", "left").join(known, ["slug", "label"], "left").join(anchors, ["slug", "label"], "left")
    reason = F.when(F.col("by_label"), "").when(F.col("by_anchor"), "anchor only").when(F.col("held"), "no such label").otherwise("no such paper")
    return rows.select("slug", "label", "uses", reason.alias("reason"))


def cited_both_ways(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """(slug, tag, side): tags cited in a paper's text but not listed for it in the store, and the other way round."""
    text = cited_tags(blocks).select("slug", "tag").distinct()
    listed = store.select("tag", F.explode("cited_by").alias("e")).select(F.col("e.slug").alias("slug"), "tag").filter("coalesce(slug, '') <> '' and tag is not null").distinct()
    listed = listed.join(blocks.select("slug").distinct(), "slug", "left_semi")
    return text.subtract(listed).withColumn("side", F.lit("cited_not_listed")).unionByName(listed.subtract(text).withColumn("side", F.lit("listed_not_cited")))


def residue(blocks: DataFrame) -> DataFrame:
    """(slug, stem, commands, odd_blanks): leftovers of conversion by chapter, where there are any."""
    said = F.coalesce("text", F.lit(""))
    counts = blocks.select("slug", "stem", F.regexp_count(said, F.lit(r"\\[a-zA-Z]+")).alias("c"), F.regexp_count(said, F.lit(r"  +|\n")).alias("b"))
    rows = counts.groupBy("slug", "stem").agg(F.sum("c").alias("commands"), F.sum("b").alias("odd_blanks"))
    return rows.filter("commands + odd_blanks > 0")


def scoped(defects: DataFrame) -> DataFrame:
    """(slug, mine, elsewhere): a paper's own defects and those of all others; defects has slug."""
    own = defects.groupBy("slug").agg(F.count("*").alias("mine"))
    total = own.agg(F.coalesce(F.sum("mine"), F.lit(0)).alias("whole"))
    return own.join(F.broadcast(total)).select("slug", "mine", (F.col("whole") - F.col("mine")).alias("elsewhere"))


def report_markers(reports: DataFrame) -> DataFrame:
    """(report, pos, target) of the ``(lit:...)`` markers of report texts (report, text)."""
    found = F.regexp_extract_all("text", F.lit(r"\(lit:([^)\s]*)\)"), F.lit(1))
    return reports.select("report", F.posexplode(found).alias("pos", "target"))


def check_markers(markers: DataFrame, blocks: DataFrame, papers: DataFrame, store: DataFrame) -> DataFrame:
    """Markers with ``reason``: no such record, paper, chapter or anchor, the first that fails; '' if none does."""
    part = lambda p: F.regexp_extract("target", r"^([^/#]+)(?:/([^/#]+))?(?:#(.+))?$", p)
    m = markers.select("*", part(1).alias("slug"), part(2).alias("stem"), part(3).alias("anchor"))
    is_record = F.col("slug") == "ref"
    tags = store.select(F.col("tag").alias("stem")).filter("stem is not null").distinct().withColumn("has_tag", F.lit(True))
    held = papers.select("slug").distinct().withColumn("has_paper", F.lit(True))
    stems = blocks.select("slug", "stem").distinct().withColumn("has_stem", F.lit(True))
    anchors = blocks.select("slug", "stem", "anchor").distinct().withColumn("has_anchor", F.lit(True))
    rows = m.join(tags, "stem", "left").join(held, "slug", "left").join(stems, ["slug", "stem"], "left").join(anchors, ["slug", "stem", "anchor"], "left")
    reason = F.when(is_record, F.when(F.col("has_tag"), "").otherwise("no such record")).when(F.col("has_paper").isNull(), "no such paper")
    reason = reason.when((F.col("stem") != "") & F.col("has_stem").isNull(), "no such chapter").when((F.col("anchor") != "") & F.col("has_anchor").isNull(), "no such anchor").otherwise("")
    return rows.select(*markers.columns, reason.alias("reason"))
