"""Upkeep of a collection: known papers, its index, renames, rewritten tags, placed labels, warnings and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import works as W

# Warnings of an ingest and the codes they answer to, the first that fits; residue is reported elsewhere.
WARNINGS = [
    ("TexSoup could not parse", "PARSER_FALLBACK"), ("INSPIRE-HEP gave no record", "INSPIRE_NO_RECORD"), ("INSPIRE-HEP holds this paper", "INSPIRE_NO_JOURNAL"),
    ("INSPIRE-HEP lookup failed", "INSPIRE_LOOKUP_FAILED"), ("bibliography could not be resolved", "BIBLIOGRAPHY_FAILED"), ("cross-reference label", "UNRESOLVED_REFS"),
    ("figure source not found", "FIGURE_SOURCE_MISSING"), ("figure not converted", "FIGURE_CONVERTER_MISSING"), ("could not be confirmed against", "UNVERIFIED_REFERENCES"),
]
RESIDUE = "placeholder residue"
DESCRIPTION = 160
# End.
SHOWN = 5
CITE = r"\[cite: *([^\]]*)\]"


def known_papers(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """(slug, held): papers of the collection and those that the store says cite something."""
    held = papers.select("slug").distinct().withColumn("held", F.lit(True))
    every = citations.select("slug").unionByName(papers.select("slug")).filter("coalesce(slug, '') <> ''").distinct()
    return every.join(held, "slug", "left").select("slug", F.coalesce("held", F.lit(False)).alias("held"))


def belongs_to(where: Column | str, slug: Column | str) -> Column:
    """Is a path the paper's or below it?"""
    return (T.c(where) == T.c(slug)) | F.startswith(T.c(where), F.concat(T.c(slug), F.lit("/")))


def warning_codes(papers: DataFrame) -> DataFrame:
    """(slug, code, detail): every warning of an ingest with the first code that fits, else OTHER; residue is left out."""
    rows = papers.select("slug", F.explode("warnings").alias("warning")).filter(~F.contains(F.lower("warning"), F.lit(RESIDUE)))
    code = F.lit("OTHER")
    for said, name in reversed(WARNINGS):
        code = F.when(F.contains(F.lower("warning"), F.lit(said.lower())), name).otherwise(code)
    return rows.select("slug", code.alias("code"), T.collapse("warning").alias("detail"))


def ingest_report(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """(slug, chapters, figures, figures_without_file, authors, warnings, unresolved_refs, references): what an ingest brought."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    bare = F.coalesce(F.size(F.filter("figures", lambda f: F.coalesce(f["file"], F.lit("")) == "")), F.lit(0))
    cited = citations.groupBy("slug").agg(F.count("*").alias("references"))
    rows = papers.select("slug", size("chapters").alias("chapters"), size("figures").alias("figures"), F.greatest(bare, F.lit(0)).cast("long").alias("figures_without_file"), size("authors").alias("authors"), size("warnings").alias("warnings"), size("unresolved_refs").alias("unresolved_refs"))
    return rows.join(cited, "slug", "left").fillna(0, ["references"])


def chapters_with_text(blocks: DataFrame) -> DataFrame:
    """(slug, stem, has_text): does a chapter hold anything beside headings and empty blocks?"""
    said = (F.col("kind") != "heading") & (F.trim(T.display_of_block()) != "")
    return blocks.groupBy("slug", "stem").agg(F.coalesce(F.bool_or(said), F.lit(False)).alias("has_text"))


def index_row(description: Column) -> Column:
    """A paper's row of the collection's index."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    title = T.escape_cell(F.coalesce(F.nullif("title", F.lit("")), "slug"))
    names = dash(T.escape_cell(T.display_names("authors", 1)))
    cells = [F.concat(F.lit("["), title, F.lit("]("), "slug", F.lit("/INDEX.md)")), names, dash(F.col("submitted_year").cast("string")), dash(T.escape_cell(F.coalesce("publication.journal", F.lit("")))), dash(T.escape_cell(description))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def upsert_index(index: DataFrame, papers: DataFrame) -> DataFrame:
    """(slug, row, action, place): the collection's index with papers put into it.

    ``index`` has slug, row and place.  A paper that stands in it keeps its row but for the Journal
    cell; a new one gets a row of its own, described by the first sentence of its abstract.  Rows are
    ordered by year, unknown years first, then by when they came; nothing is sorted in one task but
    the rows of one year.
    """
    fresh = papers.select("slug", index_row(T.first_sentence("abstract", DESCRIPTION)).alias("new"), F.coalesce(F.nullif(T.escape_cell(F.coalesce("publication.journal", F.lit(""))), F.lit("")), F.lit("—")).alias("journal"))
    both = index.select("slug", "row", "place").join(fresh, "slug", "full")
    cells = F.split(F.regexp_replace("row", r"^\| | \|$", ""), r" (?<!\\)\| ")
    kept = F.when(F.col("new").isNull() | (F.size(cells) < 5), F.col("row")).otherwise(F.concat(F.lit("| "), F.concat_ws(" | ", F.slice(cells, 1, 3), F.array("journal"), F.slice(cells, 5, 100)), F.lit(" |")))
    row = F.when(F.col("row").isNull(), F.col("new")).otherwise(kept)
    action = F.when(F.col("row").isNull(), "added").when(F.col("new").isNull(), "kept").when(row == F.col("row"), "present").otherwise("journal")
    rows = both.select("slug", row.alias("row"), action.alias("action"), F.col("place").alias("before"))
    year = F.coalesce(F.get(F.split("row", r" (?<!\\)\| "), F.lit(2)).try_cast("int"), F.lit(0))
    rows = rows.withColumn("year", year)
    own = F.row_number().over(Window.partitionBy("year").orderBy(F.col("before").asc_nulls_last(), "slug"))
    starts = rows.groupBy("year").agg(F.count("*").alias("n")).select("year", F.coalesce(F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = rows.withColumn("own", own).join(F.broadcast(starts), "year")  # a row for each year
    return placed.select("slug", "row", "action", (F.col("start") + F.col("own")).cast("long").alias("place"))


def renamed_files(rows: DataFrame, renames: DataFrame, column: str = "file") -> DataFrame:
    """Rows (slug and a file name) with the new names of renamed files (slug, old, new)."""
    named = renames.groupBy("slug", F.col("old").alias(column)).agg(F.min("new").alias("new_name"))
    return rows.join(named, ["slug", column], "left").withColumn(column, F.coalesce("new_name", column)).drop("new_name").select(rows.columns)


def rewritten_citations(blocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """(slug, stem, idx, rewritten): texts whose citation markers changed, keys put for what ``mapping`` (slug, key, tags) says.

    One key may become several tags, in their order, and an unknown key stays as it is; text outside
    of markers is never touched.  Markers are exploded, joined and put back, so a key that a third of
    all texts cite costs one row for each use.
    """
    said = F.coalesce("text", F.lit(""))
    pieces = blocks.select("slug", "stem", "idx", said.alias("said"), F.split(said, CITE.replace("(", "").replace(")", ""), -1).alias("between"), F.regexp_extract_all(said, F.lit(CITE), F.lit(1)).alias("markers")).filter(F.size("markers") > 0)
    keys = pieces.select("slug", "stem", "idx", F.posexplode("markers").alias("m", "inner")).select("slug", "stem", "idx", "m", F.posexplode(F.split("inner", ",")).alias("p", "key")).withColumn("key", T.collapse("key")).filter("key <> ''")
    named = keys.join(mapping.select("slug", "key", "tags"), ["slug", "key"], "left").withColumn("tags", F.coalesce("tags", F.array("key")))
    inner = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "tags"))), lambda x: x["tags"])), ", ")
    whole = named.groupBy("slug", "stem", "idx", "m").agg(inner.alias("inner"))
    back = whole.groupBy("slug", "stem", "idx").agg(F.map_from_entries(F.collect_list(F.struct("m", F.concat(F.lit("[cite: "), "inner", F.lit("]"))))).alias("back"))
    marker = lambda i: F.coalesce(F.try_element_at("back", i), F.concat(F.lit("[cite: "), F.get("markers", i), F.lit("]")))
    joined = F.array_join(F.transform("between", lambda t, i: F.concat(t, F.when(i < F.size("markers"), marker(i)).otherwise(F.lit("")))), "")
    rows = pieces.join(back, ["slug", "stem", "idx"], "left").select("slug", "stem", F.col("idx").cast("long").alias("idx"), "said", joined.alias("rewritten"))
    return rows.filter("rewritten <> said").drop("said")


def tag_rewrites(blocks: DataFrame, rewrites: DataFrame) -> DataFrame:
    """rewritten_citations() for (tag, to): one tag for another, in every paper."""
    pairs = rewrites.select(F.col("tag").alias("key"), F.array("to").alias("tags"))
    used = blocks.select("slug", F.explode(T.cite_tags("text")).alias("key")).withColumn("key", T.collapse("key")).distinct()
    return rewritten_citations(blocks, used.join(pairs, "key").select("slug", "key", "tags"))


def placed_labels(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(slug, label, stem): the chapter that holds a label's anchor, else the first of the chapter it was numbered in, else ''."""
    labels = papers.select("slug", F.explode("labels").alias("label", "v")).select("slug", "label", F.col("v.anchor").alias("anchor"), F.col("v.chapter").alias("title"))
    anchors = blocks.filter("coalesce(anchor, '') <> ''").groupBy("slug", "anchor").agg(F.min("stem").alias("by_anchor"))
    titles = papers.select("slug", F.posexplode("chapters").alias("at", "c")).select("slug", "at", F.col("c.title").alias("title"), F.col("c.stem").alias("stem")).groupBy("slug", "title").agg(F.min_by("stem", "at").alias("by_title"))
    rows = labels.join(anchors, ["slug", "anchor"], "left").join(titles, ["slug", "title"], "left")
    return rows.select("slug", "label", F.coalesce("by_anchor", "by_title", F.lit("")).alias("stem"))


def ownership(probe: DataFrame, key: str, papers: DataFrame) -> DataFrame:
    """(key, slug, by): the paper that a record is, by arXiv id first, then by DOI."""
    held = W.held_index(papers)
    keys = W.keyed(probe, key).filter("priority < 2").join(held, "identity")
    rank = F.when(F.startswith("identity", F.lit("arxiv:")), 0).otherwise(1)
    best = keys.groupBy(key).agg(F.min_by(F.struct("slug", "identity"), F.struct(rank, "slug")).alias("b"))
    return best.select(key, F.col("b.slug").alias("slug"), F.substring_index("b.identity", ":", 1).alias("by"))


def citers(store: DataFrame) -> DataFrame:
    """(held, slug): for each held paper the other papers that cite its work."""
    edges = store.filter("coalesce(held_as, '') <> ''").select(F.col("held_as").alias("held"), F.explode("cited_by.slug").alias("slug"))
    return edges.filter("coalesce(slug, '') <> '' and slug <> held").distinct()


def removal(papers: DataFrame, store: DataFrame, slug: str, force: bool = False) -> dict[str, object]:
    """What taking a paper out means: what is left of papers, works that are no longer held, and who stands in the way.

    ``papers`` and ``works`` are tables to write back; without ``force`` a cited paper is not removed
    and both are as they were.
    """
    against = citers(store).filter(F.col("held") == slug)
    count = against.count()
    if papers.filter(F.col("slug") == slug).isEmpty():
        raise ValueError(f"no such paper in the collection: {slug}")
    if count and not force:
        return {"removed": False, "cited_by": count, "papers": papers, "works": store, "unheld": 0}
    left = papers.filter(F.col("slug") != slug)
    held = W.mark_held(store, left).select("work_id", "held")
    works = store.join(held, "work_id").withColumn("held_as", F.col("held")).select(store.columns)
    unheld = store.filter(F.col("held_as") == slug).join(held.filter("held is null"), "work_id", "left_semi").count()
    return {"removed": True, "cited_by": count, "papers": left, "works": works, "unheld": unheld}
