"""Rendered views: Markdown of chapters, pages of papers and works, links for markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def block_markdown() -> Column:
    """One block as Markdown."""
    kind = F.col("kind")
    hashes = F.repeat(F.lit("#"), F.coalesce("level", F.lit(2)).cast("int"))
    number = F.when(F.coalesce("number", F.lit("")) != "", F.concat("number", F.lit(" "))).otherwise(F.lit(""))
    out = F.when(kind == "heading", F.concat(hashes, F.lit(" "), number, F.coalesce("title", F.lit(""))))
    out = out.when(kind == "paragraph", T.collapse("text")).when(kind == "math", F.concat(F.lit("$$\n"), "tex", F.lit("\n$$")))
    out = out.when(kind == "figure", F.concat(F.lit("!["), T.collapse("caption"), F.lit("]("), "file", F.lit(")")))
    out = out.when(kind == "table", T.collapse("caption")).when(kind == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
    return F.coalesce(out, F.lit(""))


def chapters(blocks: DataFrame) -> DataFrame:
    """(slug, stem, markdown): the blocks of each chapter in order, empty ones left out."""
    rows = blocks.select("slug", "stem", "idx", block_markdown().alias("md")).filter("md <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "md")))
    return rows.groupBy("slug", "stem").agg(F.array_join(F.transform(ordered, lambda x: x["md"]), "\n\n").alias("markdown"))


def substituted(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """(slug, stem, idx, rendered): texts with citation markers made names where every tag of the marker is known.

    Markers are exploded, joined with the store and put back in order; a marker with an unknown tag stays.
    """
    text = F.coalesce("text", F.lit(""))
    names = store.filter("tag is not null").groupBy("tag").agg(F.min(T.citation_text("authors", "year")).alias("name"))
    pieces = blocks.select("slug", "stem", "idx", F.split(text, r"\[cite: *[^\]]*\]", -1).alias("between"), F.regexp_extract_all(text, F.lit(r"\[cite: *([^\]]*)\]"), F.lit(1)).alias("markers"))
    pieces = pieces.filter(F.size("markers") > 0)
    single = pieces.select("slug", "stem", "idx", F.posexplode("markers").alias("m", "inner")).select("slug", "stem", "idx", "m", "inner", F.posexplode(F.split("inner", " *, *")).alias("p", "tag"))
    named = single.join(names, "tag", "left")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"]), "; ")
    whole = named.groupBy("slug", "stem", "idx", "m").agg(F.bool_and(F.col("name").isNotNull()).alias("known"), ordered.alias("names"), F.min("inner").alias("inner"))
    shown = F.when(F.col("known"), F.concat(F.lit("("), "names", F.lit(")"))).otherwise(F.concat(F.lit("[cite: "), "inner", F.lit("]")))
    back = whole.groupBy("slug", "stem", "idx").agg(F.array_sort(F.collect_list(F.struct("m", shown.alias("s")))).alias("s"))
    joined = F.array_join(F.transform("between", lambda t, i: F.concat(t, F.coalesce(F.get(F.col("s"), i)["s"], F.lit("")))), "")
    return pieces.join(back, ["slug", "stem", "idx"]).select("slug", "stem", F.col("idx").cast("long").alias("idx"), joined.alias("rendered"))


def linked(blocks: DataFrame, store: DataFrame, papers: DataFrame, prefix: str = "../../references") -> DataFrame:
    """(slug, stem, idx, linked): texts whose citation and reference markers are links where all that they name is known.

    A citation marker becomes one pair of brackets with a link to every work's page; if one of its
    tags has no record it stays.  A reference marker becomes the number of what it names, linked to its
    chapter unless that is the same; an unknown label stays.  Markers of both kinds are exploded once,
    joined and put back in their order.
    """
    text = F.coalesce("text", F.lit(""))
    bare, kept = r"\[(?:cite|ref): *[^\]]*\]", r"(\[(?:cite|ref): *[^\]]*\])"
    names = store.filter("coalesce(tag, '') <> ''").groupBy("tag").agg(F.min(T.citation_text("authors", "year")).alias("name"))
    labels = papers.select("slug", F.explode("labels").alias("value", "v")).select("slug", "value", F.coalesce("v.number", F.lit("")).alias("number"), F.coalesce("v.anchor", F.lit("")).alias("anchor"), F.coalesce("v.file", F.lit("")).alias("file"))
    pieces = blocks.select("slug", "stem", "idx", F.split(text, bare, -1).alias("between"), F.regexp_extract_all(text, F.lit(kept), F.lit(1)).alias("markers")).filter(F.size("markers") > 0)
    single = pieces.select("slug", "stem", "idx", F.posexplode("markers").alias("m", "marker"))
    inner = F.regexp_extract("marker", r"^\[(?:cite|ref): *([^\]]*)\]$", 1)
    cited = single.filter(F.startswith("marker", F.lit("[cite:"))).select("slug", "stem", "idx", "m", "marker", F.posexplode(F.split(inner, ",")).alias("p", "tag")).withColumn("tag", T.collapse("tag")).filter("tag <> ''")
    link = F.concat(F.lit("["), "name", F.lit(f"]({prefix}/"), "tag", F.lit(".md)"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", link.alias("s")))), lambda x: x["s"]), "; ")
    cited = cited.join(names, "tag", "left").groupBy("slug", "stem", "idx", "m").agg(F.bool_and(F.col("name").isNotNull()).alias("known"), shown.alias("s"))
    cited = cited.filter("known").select("slug", "stem", "idx", "m", F.concat(F.lit("("), "s", F.lit(")")).alias("s"))
    refs = single.filter(F.startswith("marker", F.lit("[ref:"))).withColumn("value", T.collapse(inner)).join(labels, ["slug", "value"])
    fragment = F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(F.lit(""))
    target = F.when(F.col("file") == F.col("stem"), F.lit("")).otherwise(F.concat("file", F.lit(".md")))
    refs = refs.select("slug", "stem", "idx", "m", F.concat(F.lit("["), "number", F.lit("]("), target, fragment, F.lit(")")).alias("s"))
    back = cited.unionByName(refs).groupBy("slug", "stem", "idx").agg(F.map_from_entries(F.collect_list(F.struct("m", "s"))).alias("back"))
    marker = lambda i: F.coalesce(F.try_element_at("back", i), F.get("markers", i), F.lit(""))
    joined = F.array_join(F.transform("between", lambda t, i: F.concat(t, marker(i))), "")
    return pieces.join(back, ["slug", "stem", "idx"], "left").select("slug", "stem", F.col("idx").cast("long").alias("idx"), joined.alias("linked"))


def anchored_markdown(flavor: str) -> Column:
    """A block's Markdown with its address, before it for ``vscode`` and behind it for ``obsidian``; formulas are made safe."""
    md = F.when(F.col("kind") == "paragraph", T.safe_prose(T.collapse("text"))).when(F.col("kind") == "math", F.concat(F.lit("$$\n"), T.safe_math("tex"), F.lit("\n$$"))).otherwise(block_markdown())
    md = F.coalesce(md, F.lit(""))
    bare = (F.coalesce("anchor", F.lit("")) == "") | (md == "")
    if flavor == "vscode":
        return F.when(bare, md).otherwise(F.concat(F.lit('<a id="'), "anchor", F.lit('"></a>\n\n'), md))
    below = F.when(F.col("kind") == "heading", F.lit("")).when(F.col("kind") == "paragraph", F.concat(F.lit(" ^"), "anchor")).otherwise(F.concat(F.lit("\n^"), "anchor"))
    return F.when(bare, md).otherwise(F.concat(md, below))


def flavored_chapters(blocks: DataFrame, flavor: str = "vscode") -> DataFrame:
    """chapters() with addresses in the way of an editor."""
    rows = blocks.select("slug", "stem", "idx", anchored_markdown(flavor).alias("md")).filter("md <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "md")))
    return rows.groupBy("slug", "stem").agg(F.array_join(F.transform(ordered, lambda x: x["md"]), "\n\n").alias("markdown"))


def identity_rows(papers: DataFrame) -> DataFrame:
    """(slug, at, name, value): the identity table of a paper's page, unknown values as a dash."""
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("—"))
    values = [("Authors", dash(T.display_names("authors", 3))), ("Submitted", dash(F.col("submitted_year").cast("string"))), ("arXiv", dash(F.col("arxiv_id"))), ("Journal", dash(F.col("publication.journal"))),
              ("Published", dash(F.col("publication.published_year").cast("string"))), ("DOI", dash(F.coalesce(F.nullif("publication.doi", F.lit("")), "doi"))), ("Ingested", dash(F.col("ingested")))]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), T.escape_cell(v).alias("value")) for n, v in values])
    return papers.select("slug", F.posexplode(rows).alias("at", "r")).select("slug", F.col("at").cast("long").alias("at"), "r.name", "r.value")


def work_pages(store: DataFrame) -> DataFrame:
    """(work_id, page): the page of each work: title, who and when, where it appeared, identifiers and what cites it."""
    none = F.expr("filter(cited_by, x -> false)")
    slugs = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("cited_by", none), lambda e: e["slug"]), lambda x: F.coalesce(x, F.lit("")) != "")))
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    title = F.coalesce(F.nullif(T.collapse("title"), F.lit("")), F.nullif("tag", F.lit("")), F.lit("—"))
    lines = [F.concat(F.lit("# "), title), T.citation_text("authors", "year"), line("Journal", F.col("journal")), line("DOI", F.col("doi")), line("arXiv", F.col("arxiv_id")), line("Citations", F.col("citation_count").cast("string")), line("Held as", F.col("held_as")), line("Cited by", F.array_join(slugs, ", "))]
    return store.select("work_id", F.concat_ws("\n", *lines).alias("page"))


def paper_pages(papers: DataFrame) -> DataFrame:
    """(slug, page): title, authors, journal and the chapter table with its total of words."""
    rows = F.transform(F.coalesce("chapters", F.expr("filter(chapters, x -> false)")), lambda c: F.concat(F.lit("| "), F.coalesce(c["number"], F.lit("")), F.lit(" | "), T.escape_cell(F.coalesce(c["title"], F.lit(""))), F.lit(" | "), F.coalesce(c["words"], F.lit(0)).cast("string"), F.lit(" |")))
    total = F.aggregate(F.coalesce("chapters", F.expr("filter(chapters, x -> false)")), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["words"], F.lit(0)))
    page = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("—"))), T.display_authors("authors"), F.coalesce(F.nullif("journal_ref", F.lit("")), F.lit("—")), F.array_join(rows, "\n"), F.concat(F.lit("words: "), F.coalesce(total, F.lit(0)).cast("string")))
    return papers.select("slug", page.alias("page"))


def work_rows(store: DataFrame) -> DataFrame:
    """(work_id, row): each work as a row of the reference table."""
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("—"))
    cells = F.concat_ws(" | ", dash(F.col("tag")), T.escape_cell(dash(F.col("title"))), T.citation_text("authors", "year"), dash(F.col("journal")), F.coalesce(F.col("citation_count").cast("string"), F.lit("—")))
    return store.select("work_id", F.concat(F.lit("| "), cells, F.lit(" |")).alias("row"))
