"""Clean views of the stored tables: one row for each paper, block, citation and record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.runtime import table


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest manifest of each slug; of two of one day, the later parser name."""
    raw = table(spark, sf_dir, "papers").filter("slug is not null")
    order = F.struct(F.coalesce("ingested", F.lit("")), F.coalesce("parser", F.lit("")))
    return raw.groupBy("slug").agg(F.max_by(F.struct(*[x for x in raw.columns if x != "slug"]), order).alias("r")).select("slug", "r.*")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blocks; one delivered twice counts once.

    Rows are laid out by chapter, which serves the removal of repeats and every window over a chapter after it: one exchange.
    """
    return table(spark, sf_dir, "blocks").repartition("slug", "stem").dropDuplicates(["slug", "stem", "idx"])


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "works")


def citations(works_df: DataFrame) -> DataFrame:
    """(slug, work_id): which paper cites which work, each once; unknown and empty slugs are left out."""
    edges = works_df.select("work_id", F.explode("cited_by").alias("e")).select(F.col("e.slug").alias("slug"), "work_id")
    return edges.filter("slug is not null and slug <> ''").distinct()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fetch of each catalogue record."""
    raw = table(spark, sf_dir, "inspire_record")
    number = F.col("metadata.control_number")
    return raw.filter(number.isNotNull()).groupBy(number.alias("control_number")).agg(F.max_by("metadata", "fetched_at").alias("metadata"))
