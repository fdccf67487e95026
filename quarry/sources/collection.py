"""Collections on disk: manifests, block lines, the hidden reference store, feeds; and the sinks back to disk."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources import files

BLOCK = "kind string, anchor string, level int, number string, title string, text string, env string, tex string, numbers array<string>, file string, caption string, language string"
CHAPTER = "struct<stem:string,number:string,title:string,bytes:int,blocks:int,words:int,anchors:array<string>,subsections:array<string>>"
FIGURE = "struct<file:string,label:string,number:string,chapter:string,chapter_stem:string,anchor:string,caption:string>"
PAPER = (
    "slug string, arxiv_id string, title string, authors array<string>, year int, submitted_year int, abs_url string, journal_ref string, doi string, abstract string, ingested string, parser string, "
    "publication struct<source:string,journal:string,published_year:int,doi:string,errata:array<string>,inspire_url:string>, "
    f"chapters array<{CHAPTER}>, figures array<{FIGURE}>, labels map<string,struct<kind:string,number:string,anchor:string,chapter:string,file:string>>, unresolved_refs array<string>, warnings array<string>"
)
WORK = (
    "tag string, title string, authors array<string>, year int, journal string, journal_key string, doi string, arxiv_id string, inspire_id string, citation_count int, source string, match string, "
    "verified boolean, held_as string, first_seen string, raw string, cited_by array<struct<slug:string,key:string>>"
)
STORE = ".references.jsonl"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _texts(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Whole files of a pattern on any file system; None where there are none."""
    try:
        return spark.read.text(pattern, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row for each ``*/paper.json``; a root without papers is an empty table."""
    rows = _texts(spark, f"{root}/*/paper.json")
    if rows is None:
        return _empty(spark, PAPER)
    parsed = rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/paper\.json$", 1).alias("dir"), F.from_json("value", PAPER, {"mode": "FAILFAST"}).alias("p"))
    return parsed.select(F.col("dir").alias("slug"), *[f"p.{n}" for n in parsed.schema["p"].dataType.names if n != "slug"])


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Rows of ``*/text/*.jsonl`` with slug, stem and idx; control signs are dropped before parsing.

    A line that is not JSON fails with its chapter and number; whole files are read so that lines keep their order.
    """
    texts = _texts(spark, f"{root}/*/text/*.jsonl")
    if texts is None:
        return _empty(spark, "slug string, stem string, idx int, " + BLOCK)
    path = F.col("_metadata.file_path")
    texts = texts.select(F.regexp_extract(path, r"([^/]+)/text/[^/]+$", 1).alias("slug"), F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).alias("stem"), "value")
    lines = texts.select("slug", "stem", F.posexplode(F.split("value", "\n")).alias("line", "json")).filter("trim(json) <> ''")
    clean = F.regexp_replace("json", r"[\x00-\x08\x0b-\x1f]", "")
    parsed = lines.select("slug", "stem", "line", F.from_json(clean, BLOCK + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("b"))
    bad = F.raise_error(F.concat(F.lit("not a block: "), "slug", F.lit("/"), "stem", F.lit(" line "), (F.col("line") + 1).cast("string")))
    checked = parsed.withColumn("kind", F.when(F.col("b._corrupt").isNotNull(), bad).otherwise(F.col("b.kind")))
    idx = F.row_number().over(Window.partitionBy("slug", "stem").orderBy("line")) - 1
    names = [n for n in parsed.schema["b"].dataType.names if n not in ("kind", "_corrupt")]
    return checked.withColumn("idx", idx).select("slug", "stem", "idx", "kind", *[f"b.{n}" for n in names])


def read_paper(spark: SparkSession, root: str, slug: str) -> DataFrame:
    """The manifest of one paper; an unknown one is an error."""
    found = read_manifests(spark, root).filter(F.col("slug") == slug)
    if found.isEmpty():
        raise FileNotFoundError(f"no such paper in {root}: {slug}")
    return found


def stored_texts(spark: SparkSession, root: str) -> DataFrame:
    """(slug, stem, path): the stored chapters in name order, renders left out."""
    texts = _texts(spark, f"{root}/*/text/*.jsonl")
    if texts is None:
        return _empty(spark, "slug string, stem string, path string")
    path = F.col("_metadata.file_path")
    return texts.select(F.regexp_extract(path, r"([^/]+)/text/[^/]+$", 1).alias("slug"), F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).alias("stem"), path.alias("path")).orderBy("slug", "stem")


def raw_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, nuls): stored chapters as they are, broken bytes made visible, with the number of NUL signs."""
    try:
        rows = spark.read.format("binaryFile").load(f"{root}/*/text/*.jsonl")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return _empty(spark, "path string, text string, nuls long")
        raise
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("text")).withColumn("nuls", (F.length("text") - F.length(F.translate("text", "\x00", ""))).cast("long"))


def report_sources(spark: SparkSession, root: str) -> DataFrame:
    """(report, text): every ``*.source.md`` below a folder."""
    try:
        rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.source.md")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return _empty(spark, "report string, text string")
        raise
    return rows.select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The reference store of a collection.

    Spark's file sources pass over names with a leading dot, so a source of its own reads the file in
    byte ranges; a missing store is empty, a line that is not JSON fails with its number.
    """
    path = f"{root}/{STORE}"
    if not files.exists(path):
        return _empty(spark, WORK)
    spark.dataSource.register(files.LineSource)
    rows = spark.read.format("lines").load(path).filter("trim(line) <> ''")
    parsed = rows.select("at", F.from_json("line", WORK + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("w"))
    broken = parsed.filter("w._corrupt is not null").agg(F.min("at")).first()[0]
    if broken is not None:
        raise ValueError(f"{STORE} line {files.line_at(path, broken)} is not a record")
    return parsed.select(*[f"w.{n}" for n in parsed.schema["w"].dataType.names if n != "_corrupt"])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed of preprints."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string, journal_ref string, comment string"
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    tail = F.regexp_extract("id", r"abs/(.+)$", 1)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(
        F.regexp_replace(tail, r"v[0-9]+$", "").alias("arxiv_id"), F.regexp_extract(tail, r"(v[0-9]+)$", 1).alias("version"), squeeze("title").alias("title"),
        F.transform("author", lambda a: a["name"]).alias("authors"), F.substring("published", 1, 4).try_cast("int").alias("year"), "published",
        squeeze("summary").alias("summary"), "doi", "journal_ref", "comment", F.col("id").alias("abs_url"),
    )


def write_blocks(blocks: DataFrame, root: str) -> None:
    """Blocks as Parquet, one partition for each paper; only the papers at hand are overwritten."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(root)


def block_lines(blocks: DataFrame) -> DataFrame:
    """(slug, stem, lines): chapters as JSON lines with sorted keys and no empty fields."""
    names = sorted(c for c in blocks.columns if c not in ("slug", "stem", "idx"))
    rows = blocks.select("slug", "stem", F.struct("idx", F.to_json(F.struct(*names)).alias("j")).alias("r"))
    return rows.groupBy("slug", "stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), "\n").alias("lines"))


def write_store(works: DataFrame, root: str) -> int:
    """Save a store sorted by tag: executors write the parts, which are joined beside the store and then take its place.

    The one file is what a collection is; its bytes stream past the driver and are never held there.
    """
    system, base = files.opened(root)
    system.create_dir(base, recursive=True)
    staging = f"{base}/.store-{uuid.uuid4().hex}"
    address = root.split("://")[0] + "://" + staging if "://" in root and not root.startswith("file://") else staging
    works.orderBy("tag").select(F.to_json(F.struct(*sorted(works.columns))).alias("j")).write.text(address)
    parts = sorted(i.path for i in system.get_file_info(files.fs.FileSelector(staging)) if i.base_name.startswith("part-"))
    n = 0
    with system.open_output_stream(f"{staging}.joined") as out:
        for part in parts:
            with system.open_input_stream(part) as source:
                while chunk := source.read(1 << 20):
                    out.write(chunk)
                    n += chunk.count(b"\n")
    system.move(f"{staging}.joined", f"{base}/{STORE}")
    system.delete_dir(staging)
    return n


def write_block_lines(blocks: DataFrame, root: str) -> int:
    """Store chapters as ``slug/text/stem.jsonl``, changed ones only; how many were written."""
    rows = block_lines(blocks).select(F.concat("slug", F.lit("/text/"), "stem", F.lit(".jsonl")).alias("name"), F.concat("lines", F.lit("\n")).alias("text"))
    return files.write_files(rows, root).filter("written").count()


def write_manifests(papers: DataFrame, root: str) -> int:
    """Store manifests as ``slug/paper.json``, changed ones only; how many were written."""
    names = sorted(papers.columns)
    rows = papers.select(F.concat("slug", F.lit("/paper.json")).alias("name"), F.to_json(F.struct(*names), {"pretty": "true"}).alias("text"))
    return files.write_files(rows, root).filter("written").count()


def write_pages(pages: DataFrame, root: str, name: str, text: str, suffix: str = ".md") -> dict[str, int]:
    """Write (name, text) rows as files that changed, and remove files of the suffix that no row names.

    Executors write and remove; the driver sees counts and a file listing.
    """
    rows = pages.select(F.concat(F.replace(F.col(name), F.lit("/"), F.lit("__")), F.lit(suffix)).alias("name"), F.col(text).alias("text"))
    counts = {r["written"]: r["n"] for r in files.write_files(rows, root).groupBy("written").agg(F.count("*").alias("n")).collect()}
    stale = files.listed(pages.sparkSession, root, suffix).join(rows.select("name"), "name", "left_anti")
    removed = files.remove_files(stale, root).count()
    return {"written": counts.get(True, 0), "unchanged": counts.get(False, 0), "removed": removed}


def report_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as a JSON object with sorted keys."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("line"))
