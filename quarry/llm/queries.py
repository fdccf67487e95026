"""Registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import canonical_text, entity_match, groups, markup, mixing, name_variants, packing, sentences, set_join, term_counts, tokens
from quarry.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = term_counts.term_counts(table(spark, sf_dir, "blocks"), ["slug", "stem", "idx"], ["text", "title"])
    return counted.select("term", "places", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).filter("mark <> 'keep'").select("term", "mark")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "works").select("work_id", "title", "authors")
    title = works.select("work_id", F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value"))
    names = works.select("work_id", F.lit("authors").alias("field"), F.posexplode("authors").alias("pos", "value"))
    return title.unionByName(names.withColumn("pos", F.col("pos") + 1))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.canonical_values(_values(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_values(spark, sf_dir).filter("value <> canonical").select("work_id", "field", "pos").distinct()


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "works").select("work_id", F.col("cited_by.slug").alias("slugs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = set_join.similar_pairs(_citing(spark, sf_dir), "work_id", "slugs", least=5, percent=60)
    return pairs.select(F.col("key_a").alias("work_a"), F.col("key_b").alias("work_b"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_links(_citing(spark, sf_dir), "work_id", "slugs", least=5, percent=60).withColumnRenamed("key", "work_id")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "bib_entries").select(F.col("entry_id").alias("key"), F.col("slug").alias("scope"), "title", "authors", "year", "journal")
    works = table(spark, sf_dir, "works").select(F.col("work_id").alias("key"), F.lit(None).cast("string").alias("scope"), "title", "authors", "year", "journal")
    found = entity_match.match_records(entries, works)
    return found.select(F.col("left_key").alias("entry_id"), F.col("right_key").alias("work_id"), "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("entry_id", "work_id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "works").select(F.explode("authors").alias("name"))
    records = table(spark, sf_dir, "inspire_record").select(F.explode("metadata.authors.full_name").alias("name"))
    return works.unionByName(records)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.name_pairs(_names(spark, sf_dir))


def p5_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.name_persons(_names(spark, sf_dir)).select("name", F.xxhash64("person").alias("person_id"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, works = table(spark, sf_dir, "documents"), table(spark, sf_dir, "works")

    def values(df: DataFrame, tab: str, key: str, field: str, host: str) -> DataFrame:
        return df.select(F.lit(tab).alias("tab"), F.col(key).alias("key"), F.lit(field).alias("field"), F.expr(host).alias("host"), F.col(field).alias("value"))

    texts = values(documents, "documents", "doc_id", "text", "coalesce(source, '')")
    return texts.unionByName(values(documents, "documents", "doc_id", "title", "'document title'")).unionByName(values(works, "works", "work_id", "title", "'work title'"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(_marked(spark, sf_dir)).select("tab", F.col("key").alias("rec_id"), "field", "kinds", "clean", "blocks")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_clean(spark, sf_dir).select("tab", "rec_id", "field", F.explode("kinds").alias("markup")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.publication_groups(table(spark, sf_dir, "works"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return tokens.token_counts(documents)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))
    return packed.withColumnRenamed("key", "doc_id")


def p8_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def _memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the documents, with all sources under which their text stands."""
    content = F.when(F.col("text") != "", F.md5("text"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "text", content.alias("content"))
    sizes = cut(tokens.token_counts(documents))
    return mixing.with_sources(sizes, "content", "source", table(spark, sf_dir, "mix_targets")).select("key", "tokens", "sources")


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(_memberships(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return chosen.withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _memberships(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return sentences.sentences(documents, sentences.train(documents))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sample = table(spark, sf_dir, "sentence_sample").select("doc_id").distinct()
    found = sentences.sentences(documents.join(sample, "doc_id", "left_semi"), sentences.train(documents))
    return found.select("doc_id", "start_pos", "end_pos").distinct()


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
    return {name: found[name] for name in sorted(found, key=lambda n: (int(n[1:].split("_")[0]), not n.endswith("_found"), n))}


_TERMS = r"""
WITH b AS (SELECT DISTINCT slug, stem, idx, text, title FROM blocks WHERE coalesce(text, '') <> '' OR coalesce(title, '') <> ''),
 t AS (SELECT row_number() OVER () AS r, list_concat(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{3,}'), regexp_extract_all(lower(coalesce(title, '')), '\p{L}{3,}')) AS ts FROM b),
 e AS (SELECT r, unnest(ts) AS term FROM t),
 c AS (SELECT term, count(*) AS places, count(DISTINCT r) AS records FROM e GROUP BY term),
 m AS (SELECT term, places, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 10 > (SELECT count(*) FROM b) THEN 'common' ELSE 'keep' END AS mark FROM c)
"""
_SETS = """
WITH s AS (SELECT work_id, list_sort(list_distinct(list_filter(list_transform(cited_by, lambda x: x.slug), lambda x: x IS NOT NULL AND x <> ''))) AS t FROM works),
 k AS (SELECT work_id, t, len(t) AS n FROM s WHERE len(t) >= 5),
 e AS (SELECT work_id, n, unnest(t) AS tok FROM k),
 i AS (SELECT a.work_id AS work_a, b.work_id AS work_b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.tok = b.tok AND a.work_id < b.work_id GROUP BY ALL),
 p AS (SELECT work_a, work_b FROM i WHERE shared * 100 >= 60 * (na + nb - shared))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _TERMS + "SELECT * FROM m",
        "p1_found": _TERMS + "SELECT term, mark FROM m WHERE mark <> 'keep'",
        "p3_found": _SETS + "SELECT work_a, work_b FROM p",
        "p3_links": _SETS + """, c AS (SELECT t, min(work_id) AS class_id, count(*) AS copies FROM k GROUP BY t),
 m AS (SELECT k.work_id, c.class_id, c.copies FROM k JOIN c ON k.t = c.t),
 d AS (SELECT work_a AS w, work_b AS o FROM p UNION ALL SELECT work_b, work_a FROM p),
 l AS (SELECT d.w, count(*) AS links FROM d JOIN m a ON a.work_id = d.w JOIN m b ON b.work_id = d.o WHERE a.class_id <> b.class_id GROUP BY d.w)
SELECT m.work_id, m.class_id, m.copies, coalesce(l.links, 0) AS links FROM m LEFT JOIN l ON l.w = m.work_id""",
    }
