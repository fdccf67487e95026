"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set where the caller has not: runtime re-planning and skew handling are relied on everywhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS``; Arrow batches are kept short because texts may be very long."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session, as in tests, gets a
    folder of its own where none is set; on a cluster that would lie on one machine, so it is an error.
    Reliable checkpoints survive the loss of an executor.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """A partition count that keeps every core busy with several tasks."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing is run for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a table that has fewer input splits than the cluster can use.

    The splits are reckoned from the planned size and the session's split size, so no job is run to
    count them; a table with enough splits is left where it is and never shuffled for this.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if planned_bytes(df) // split >= 2 * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks(spark), *keys)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

