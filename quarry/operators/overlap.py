"""Overlap of bibliographies: containment, overlap coefficient, Jaccard, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_COMPARABLE = 10


def sizes(edges: DataFrame) -> DataFrame:
    """(slug, works): length of each paper's list."""
    return edges.groupBy("slug").agg(F.count("*").alias("works"))


def shared(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, slug, shared): works that a candidate's list shares with another paper's.

    ``candidates`` has slug; only their edges stand on the left, so the join is as large as the
    lists of the papers that cite their works, and a paper is never compared with itself.
    """
    left = edges.join(candidates.select("slug").distinct(), "slug", "left_semi").select(F.col("slug").alias("candidate"), "work_id")
    return left.join(edges, "work_id").filter("candidate <> slug").groupBy("candidate", "slug").agg(F.count("*").alias("shared"))


def band(shared_works: Column, least: Column) -> Column:
    """high from 15 hundredths, low below 5, else partial; null for lists too short to compare. Integers only."""
    return F.when(least < MIN_COMPARABLE, F.lit(None)).when(shared_works * 100 >= 15 * least, "high").when(shared_works * 100 < 5 * least, "low").otherwise("partial")


def scores(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, slug, shared, mine, theirs, least, total, band) for every paper that shares a work."""
    n = sizes(edges)
    rows = shared(edges, candidates).join(n.select(F.col("slug").alias("candidate"), F.col("works").alias("mine")), "candidate").join(n.withColumnRenamed("works", "theirs"), "slug")
    rows = rows.withColumn("least", F.least("mine", "theirs")).withColumn("total", F.col("mine") + F.col("theirs") - F.col("shared"))
    return rows.withColumn("band", band(F.col("shared"), F.col("least"))).select("candidate", "slug", "shared", "mine", "theirs", "least", "total", "band")


def closest(edges: DataFrame, candidates: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` closest papers of each candidate by overlap in millionths, ties by slug."""
    ranked = scores(edges, candidates).withColumn("overlap_ppm", F.floor(F.col("shared") * 1_000_000 / F.col("least")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("overlap_ppm"), "slug"))
    return ranked.withColumn("place", rank).filter(F.col("place") <= top).select("candidate", "slug", "shared", "overlap_ppm", F.col("place").cast("long").alias("place"))


def containment(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, works, known, contained_ppm): how much of a list some other paper cites too."""
    mine = edges.join(candidates.select("slug").distinct(), "slug", "left_semi")
    citers = edges.groupBy("work_id").agg(F.count("*").alias("citers"))
    known = mine.join(citers, "work_id").groupBy(F.col("slug").alias("candidate")).agg(F.count("*").alias("works"), F.count_if(F.col("citers") > 1).alias("known"))
    return known.withColumn("contained_ppm", F.floor(F.col("known") * 1_000_000 / F.col("works")).cast("long"))
