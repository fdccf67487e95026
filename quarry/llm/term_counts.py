"""Frequency of every distinct term, by a global integer dictionary and count arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import all_of, cut, spread, tasks

TERM = regex.compile(r"\p{L}{3,}")
#: Identifiers per count array: two arrays of 64-bit counts, half a megabyte each.
RANGE_WIDTH = 65_536
#: A block is closed and emitted when its local dictionary holds so many terms.
BLOCK_TERMS = 200_000
#: Hash buckets that the dictionary is numbered in; the offsets table has one row for each.
BUCKETS = 4_096
#: Repeated keys that are broadcast, some ten MB; where there are more, all rows are grouped instead.
REPEATED = 100_000


def _block_counts(columns: Sequence[str]):
    """Count arrays of blocks: local identifiers, then ``bincount`` for places and for records.

    The empty term, which no text holds, carries the number of records that are not empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local: dict[str, int] = {}
        places = np.zeros(0, np.int64)
        records = np.zeros(0, np.int64)
        filled = 0

        def emit() -> pd.DataFrame:
            return pd.DataFrame({"term": [*local, ""], "places": [*places[: len(local)], 0], "records": [*records[: len(local)], filled]})

        for batch in batches:
            ids: list[int] = []
            owners: list[int] = []
            for owner, values in enumerate(zip(*(batch[c] for c in columns))):
                before = len(ids)
                filled += any(values)
                for value in values:
                    if value:
                        ids.extend([local.setdefault(t, len(local)) for t in TERM.findall(value.lower())])
                owners.append(len(ids) - before)
            if ids:
                if len(local) > len(places):
                    grow = max(1024, 2 * len(local)) - len(places)
                    places, records = np.pad(places, (0, grow)), np.pad(records, (0, grow))
                codes = np.asarray(ids, np.int64)
                counted = np.bincount(codes)
                places[: len(counted)] += counted
                pairs = np.unique(np.repeat(np.arange(len(owners), dtype=np.int64), owners) * len(local) + codes)
                counted = np.bincount(pairs % len(local))
                records[: len(counted)] += counted
            if len(local) >= BLOCK_TERMS:
                yield emit()
                local, places, records, filled = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        yield emit()

    return run


def _sum_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add block arrays into one array for each identifier range of the partition, as they stream by."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        ids = batch["term_id"].to_numpy(np.int64)
        spans = ids // RANGE_WIDTH
        for span in np.unique(spans):
            here = spans == span
            sums = held.setdefault(int(span), np.zeros((2, RANGE_WIDTH), np.int64))
            at = ids[here] - span * RANGE_WIDTH
            np.add.at(sums[0], at, batch["places"].to_numpy(np.int64)[here])
            np.add.at(sums[1], at, batch["records"].to_numpy(np.int64)[here])
    for span, sums in held.items():
        at = np.flatnonzero(sums[0])
        yield pd.DataFrame({"term_id": span * RANGE_WIDTH + at, "places": sums[0][at], "records": sums[1][at]})


def term_dictionary(terms: DataFrame) -> DataFrame:
    """Dense identifiers from 0 for the distinct values of ``terms.term``: (term, term_id).

    Terms are numbered within hash buckets and the buckets are laid end to end, so no task ever
    holds more than one bucket and only ``BUCKETS`` offsets are broadcast.
    """
    rank = Window.partitionBy("bucket").orderBy("term")
    numbered = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).withColumn("at", F.row_number().over(rank) - 1)
    sizes = numbered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return numbered.join(F.broadcast(offsets), "bucket").select("term", (F.col("offset") + F.col("at")).cast("long").alias("term_id"))


def distinct_records(df: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """The text tuples of the records of ``df``: rows of equal ``keys`` (nulls equal) are one, with the smallest tuple.

    Keys alone are grouped first, so texts are shuffled only where a key is repeated.  The repeated
    keys are broadcast while there are at most ``REPEATED`` of them; beyond, all rows are grouped.
    """
    named = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)])
    own, said = [f"k{i}" for i in range(len(keys))], [f"t{i}" for i in range(len(texts))]

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*own).agg(F.min(F.struct(*said)).alias("record")).select("record.*")

    repeated = cut(named.groupBy(*own).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(k).alias("r" + k) for k in own]))
    if repeated.count() > REPEATED:
        return spread(grouped(named))
    same = all_of(F.col(k).eqNullSafe(F.col("r" + k)) for k in own)
    once = spread(named.join(F.broadcast(repeated), same, "left_anti").select(*said))
    return once.unionByName(grouped(named.join(F.broadcast(repeated), same, "left_semi")))


def term_counts(df: DataFrame, keys: Sequence[str], texts: Sequence[str], rare_below: int = 3, common_above: float = 0.10) -> DataFrame:
    """Count every term of ``texts`` over all records: (term_id, term, places, records, mark).

    A term is a maximal run of at least three letters in a lower-cased text.  ``places`` counts all
    occurrences, ``records`` the records that hold the term; ``mark`` is ``rare`` below
    ``rare_below`` records, ``common`` above the share ``common_above`` of the records with a
    non-empty text (integer comparison in parts per million), else ``keep``.

    Rows with equal ``keys`` (nulls count as equal) are one record, represented by the smallest of
    its text tuples.  Null and empty texts hold no term; an empty table gives no rows; other
    columns are ignored.

    Counting is local to blocks of input first, so a term or record group that fills a third of
    the rows reaches the shuffle as one row for each block.
    """
    names = [f"t{i}" for i in range(len(texts))]
    counted = cut(distinct_records(df, keys, texts).mapInPandas(_block_counts(names), "term string, places long, records long"))
    total = counted.filter("term = ''").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    blocks = counted.filter("term <> ''")
    dictionary = cut(term_dictionary(blocks))
    coded = blocks.join(dictionary, "term").select("term_id", "places", "records")
    coded = coded.repartition(tasks(df.sparkSession), (F.col("term_id") / RANGE_WIDTH).cast("long"))
    summed = coded.mapInPandas(_sum_ranges, "term_id long, places long, records long")
    limit = int(round(common_above * 1_000_000)) * total
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 1_000_000 > F.lit(limit), "common").otherwise("keep")
    return summed.join(dictionary, "term_id").select("term_id", "term", "places", "records", mark.alias("mark"))
