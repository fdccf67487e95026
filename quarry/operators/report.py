"""Reports that cite the collection: one name for each work, rendered markers and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import audit
from quarry.operators import works as W

# The marker of a report, the heading of its references and the sign of an unconfirmed work.
MARKER = r"\(lit:([^)\s]*)\)"
BARE_MARKER = r"\(lit:[^)\s]*\)"
LISTED = r"(?s)^(.*)(\n#+ *(?:References|Bibliography)[^\n]*\n.*)$"
UNCONFIRMED = "⚠"
# End.


def held_names(store: DataFrame, papers: DataFrame) -> DataFrame:
    """(tag, slug): the paper that holds the work of a tag: what the record says, else by DOI or arXiv id, else of the same name.

    Of several records of one tag the first slug by letters counts.
    """
    tagged = store.filter("coalesce(tag, '') <> ''")
    hits = W.keyed(tagged, "work_id").filter("priority < 2").join(W.held_index(papers), "identity").groupBy("work_id").agg(F.min_by("slug", "priority").alias("by_key"))
    same = papers.select(F.col("slug").alias("tag"), F.col("slug").alias("by_name")).distinct()
    rows = tagged.select("work_id", "tag", F.nullif("held_as", F.lit("")).alias("said")).join(hits, "work_id", "left").join(same, "tag", "left")
    return rows.select("tag", F.coalesce("said", "by_key", "by_name").alias("slug")).filter("slug is not null").groupBy("tag").agg(F.min("slug").alias("slug"))


def cited_works(markers: DataFrame, names: DataFrame) -> DataFrame:
    """Markers (with target) and ``work``: slug:name or tag:name, one name however the work is cited; null if the marker names none."""
    tag = F.when(F.startswith("target", F.lit("ref/")), F.nullif(F.expr("substring(target, 5)"), F.lit("")))
    slug = F.when(~F.startswith("target", F.lit("ref/")), F.nullif(F.regexp_extract("target", "^([^/#]*)", 1), F.lit("")))
    rows = markers.withColumn("tag", tag).withColumn("own", slug).join(names.withColumnRenamed("slug", "held"), "tag", "left")
    work = F.coalesce(F.concat(F.lit("slug:"), F.coalesce("held", "own")), F.concat(F.lit("tag:"), "tag"))
    return rows.select(*markers.columns, "tag", work.alias("work"))


def parts(reports: DataFrame) -> DataFrame:
    """(report, body, listed): a report's prose and, from the last heading of that name on, its references."""
    text = F.coalesce("text", F.lit(""))
    cut_here = text.rlike(LISTED)
    return reports.select("report", F.when(cut_here, F.regexp_extract(text, LISTED, 1)).otherwise(text).alias("body"), F.when(cut_here, F.regexp_extract(text, LISTED, 2)).otherwise(F.lit("")).alias("listed"))


def path_of(prefix: str = "..") -> Column:
    """Where a resolvable marker's target lies, seen from a report."""
    anchor = F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(F.lit(""))
    chapter = F.concat(F.lit(f"{prefix}/"), "slug", F.lit("/chapters/"), "stem", F.lit(".md"), anchor)
    page = F.when(F.col("stem") != "", chapter).otherwise(F.concat(F.lit(f"{prefix}/"), "slug", F.lit("/INDEX.md")))
    return F.when(F.col("slug") == "ref", F.concat(F.lit(f"{prefix}/references/"), "stem", F.lit(".md"))).otherwise(page)


def rendered(reports: DataFrame, blocks: DataFrame, papers: DataFrame, store: DataFrame) -> DataFrame:
    """(report, rendered, unresolved): reports with every resolvable marker made a path and a count of the others.

    Markers are exploded, checked by joins and put back in order; one that resolves to nothing stays.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = reports.select("report", F.split(text, BARE_MARKER, -1).alias("between"), F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)).alias("markers"))
    checked = audit.check_markers(audit.report_markers(reports), blocks, papers, store)
    part = lambda p: F.regexp_extract("target", r"^([^/#]+)(?:/([^/#]+))?(?:#(.+))?$", p)
    shown = checked.select("report", "pos", "target", "reason", part(1).alias("slug"), part(2).alias("stem"), part(3).alias("anchor"))
    shown = shown.withColumn("s", F.concat(F.lit("("), F.when(F.col("reason") == "", path_of()).otherwise(F.concat(F.lit("lit:"), "target")), F.lit(")")))
    back = shown.groupBy("report").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("s"), F.count_if(F.col("reason") != "").alias("unresolved"))
    joined = F.array_join(F.transform("between", lambda t, i: F.concat(t, F.coalesce(F.get("s", i), F.lit("")))), "")
    return pieces.join(back, "report", "left").select("report", joined.alias("rendered"), F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"))


def audited(reports: DataFrame, blocks: DataFrame, papers: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each report: what it cites and what is wrong with it, and ``ok``.

    ``citations`` works cited in the prose, ``absent`` works of unknown names, ``broken`` markers that
    do not resolve, ``cite_markers`` raw markers left, works cited but not listed and the other way
    round, and ``unflagged`` unverified works whose entry lacks the sign.
    """
    names = held_names(store, papers)
    split = parts(reports)
    marked = lambda column: cited_works(audit.report_markers(split.select("report", F.col(column).alias("text"))), names).filter("work is not null")
    body, listed = marked("body"), marked("listed")
    works_of = lambda rows: rows.select("report", "work").distinct()
    cited, entries = works_of(body), works_of(listed)
    sides = cited.withColumn("cited", F.lit(1)).join(entries.withColumn("listed", F.lit(1)), ["report", "work"], "full")
    held = papers.select(F.concat(F.lit("slug:"), "slug").alias("work")).unionByName(store.filter("coalesce(tag, '') <> ''").select(F.concat(F.lit("tag:"), "tag").alias("work"))).distinct().withColumn("known", F.lit(1))
    counts = sides.join(held, "work", "left").groupBy("report").agg(
        F.count("cited").alias("citations"), F.count_if(F.col("known").isNull()).alias("absent"), F.count_if(F.col("listed").isNull()).alias("cited_not_listed"), F.count_if(F.col("cited").isNull()).alias("listed_not_cited"))
    broken = audit.check_markers(audit.report_markers(reports), blocks, papers, store).groupBy("report").agg(F.count_if(F.col("reason") != "").alias("broken"))
    unsure = store.filter("coalesce(tag, '') <> ''").groupBy("tag").agg(F.bool_or(F.coalesce("verified", F.lit(False))).alias("sure")).filter(~F.col("sure")).select("tag")
    items = split.select("report", F.explode(F.split(F.regexp_replace("listed", r"\n([-*+] )", "\x02$1"), "\x02")).alias("item"))
    flagged = items.filter(F.contains("item", F.lit(UNCONFIRMED))).select("report", F.explode(F.regexp_extract_all("item", F.lit(r"\(lit:ref/([^)\s]*)\)"), F.lit(1))).alias("tag")).distinct()
    bare = body.unionByName(listed).filter("tag is not null").select("report", "tag").distinct().join(unsure, "tag").join(flagged, ["report", "tag"], "left_anti").groupBy("report").agg(F.count("*").alias("unflagged"))
    left = reports.select("report", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[cite: *([^\]]*)\]"), F.lit(1))).cast("long").alias("cite_markers"))
    rows = left.join(counts, "report", "left").join(broken, "report", "left").join(bare, "report", "left").fillna(0)
    defects = ["absent", "broken", "cite_markers", "cited_not_listed", "listed_not_cited", "unflagged"]
    return rows.withColumn("ok", sum((F.col(c) for c in defects), F.lit(0)) == 0).select("report", "citations", *defects, "ok")
