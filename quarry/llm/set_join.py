"""All similar pairs of set-valued records, by the size-aware overlap join."""

from __future__ import annotations

from itertools import combinations
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import cut, spread

#: Sets up to this size enumerate token subsets, larger ones scan inverted lists.
SMALL = 8
#: A token in more than this share of all tokens is ordered last; there are at most so many of them.
HOT_TOKENS = 1_000


def needed(size_a: int, size_b: int, percent: int) -> int:
    """Tokens two sets of these sizes must share for a Jaccard similarity of ``percent`` hundredths."""
    return ceil(percent * (size_a + size_b) / (100 + percent) - 1e-9)


def _subset_keys(percent: int):
    """Keys of a small set: for each partner size that can match, its subsets of the needed size."""

    def keys(tokens: pd.Series) -> pd.Series:
        def of(row) -> list[int]:
            row = sorted(int(t) for t in row)
            n, out = len(row), []
            for m in range(1, SMALL + 1):
                low, high = min(n, m), max(n, m)
                if 100 * low < percent * high:
                    continue
                out += [hash((low, high, *part)) for part in combinations(row, needed(n, m, percent))]
            return out

        return tokens.map(of)

    return keys


def set_records(df: DataFrame, key: str, tokens: str, least: int) -> DataFrame:
    """(key, tokens) with null and empty tokens left out, tokens distinct and sorted, ``least`` or more of them."""
    clean = F.array_sort(F.array_distinct(F.filter(F.col(tokens), lambda t: t.isNotNull() & (t != ""))))
    return df.select(F.col(key).alias("key"), clean.alias("tokens")).filter(F.size("tokens") >= least)


def set_classes(records: DataFrame) -> DataFrame:
    """Classes of equal sets, represented by the smallest key: (rep, tokens)."""
    return records.groupBy("tokens").agg(F.min("key").alias("rep"))


def similar_classes(classes: DataFrame, percent: int = 60) -> DataFrame:
    """Pairs of different sets with Jaccard similarity of at least ``percent`` hundredths: (rep_a, rep_b, shared, total).

    Small sets meet on equal token subsets of exactly the size their sizes require; sets over
    ``SMALL`` tokens scan inverted lists of rare-first prefixes.  The union of both is
    filtered by exact overlap, so hash collisions cost time and never a wrong row.  Frequent tokens
    come last in every prefix, so the list of a token that a third of all sets hold is hardly read.
    """
    spark = classes.sparkSession
    coded = classes.select("rep", F.transform("tokens", lambda t: F.xxhash64(t)).alias("ids"), F.size("tokens").alias("n"))
    coded = cut(coded)
    tokens = coded.select(F.explode("ids").alias("id"))
    weight = max(1, tokens.count() // HOT_TOKENS)
    hot = tokens.groupBy("id").agg(F.count("*").alias("f")).filter(F.col("f") > weight)  # at most HOT_TOKENS rows
    hot = hot.select(F.map_from_entries(F.collect_list(F.struct("id", "f"))).alias("hot")) if not hot.isEmpty() else spark.range(1).select(F.expr("map(cast(0 as bigint), cast(0 as bigint))").alias("hot"))
    order = F.transform("ids", lambda t: F.struct(F.coalesce(F.col("hot")[t], F.lit(0)).alias("f"), t.alias("t")))
    coded = coded.join(F.broadcast(hot)).select("rep", "n", F.transform(F.array_sort(order), lambda x: x["t"]).alias("ids"))

    small = spread(coded.filter(F.col("n") <= SMALL)).select("rep", F.explode(F.array_distinct(F.pandas_udf(_subset_keys(percent), "array<long>")("ids"))).alias("k"))
    left, right = small.alias("a"), small.alias("b")
    by_subset = left.join(right, (F.col("a.k") == F.col("b.k")) & (F.col("a.rep") < F.col("b.rep"))).select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))

    least = F.ceil(F.col("n") * percent / 100 - 1e-9)
    listed = coded.filter(100 * F.col("n") > percent * SMALL).select("rep", "n", F.posexplode(F.slice("ids", 1, (F.col("n") - least + 1).cast("int"))).alias("at", "id"))
    left, right = listed.filter(F.col("n") > SMALL).alias("a"), listed.alias("b")
    bound = F.col("a.n") + F.col("b.n")
    upper = 1 + F.least(F.col("a.n") - F.col("a.at") - 1, F.col("b.n") - F.col("b.at") - 1)
    fits = (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (upper * (100 + percent) >= bound * percent - F.least("a.at", "b.at") * (100 + percent))
    once = (F.col("b.n") <= SMALL) | (F.col("a.rep") < F.col("b.rep"))
    by_list = left.join(right, (F.col("a.id") == F.col("b.id")) & (F.col("a.rep") != F.col("b.rep")) & fits & once)
    by_list = by_list.select(F.least("a.rep", "b.rep").alias("rep_a"), F.greatest("a.rep", "b.rep").alias("rep_b"))

    pairs = by_subset.unionByName(by_list).distinct()
    exact = pairs.join(classes.select(F.col("rep").alias("rep_a"), F.col("tokens").alias("ta")), "rep_a").join(classes.select(F.col("rep").alias("rep_b"), F.col("tokens").alias("tb")), "rep_b")
    shared = F.size(F.array_intersect("ta", "tb"))
    exact = exact.select("rep_a", "rep_b", shared.alias("shared"), (F.size("ta") + F.size("tb") - shared).alias("total"))
    return exact.filter(100 * F.col("shared") >= percent * F.col("total"))


def similar_pairs(df: DataFrame, key: str, tokens: str, least: int = 5, percent: int = 60) -> DataFrame:
    """All pairs of records with similar sets: (key_a, key_b, shared, total), key_a < key_b.

    Records with a null key or set, or with fewer than ``least`` distinct non-empty tokens, have no
    pairs.  A key that occurs twice counts as two records of one key and is never paired with
    itself.  Other columns are ignored; an empty table gives no rows.
    """
    records = cut(set_records(df, key, tokens, least).filter(F.col("key").isNotNull()))
    classes = cut(set_classes(records))
    members = cut(records.join(classes, "tokens").select("rep", "key", F.size("tokens").alias("n")))
    links = similar_classes(classes, percent)
    a, b = members.select(F.col("rep").alias("rep_a"), F.col("key").alias("x")), members.select(F.col("rep").alias("rep_b"), F.col("key").alias("y"))
    across = links.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "shared", "total")
    many = members.join(members.groupBy("rep").agg(F.count("*").alias("m")).filter("m > 1"), "rep")
    within = many.alias("a").join(many.alias("b"), (F.col("a.rep") == F.col("b.rep")) & (F.col("a.key") < F.col("b.key")))
    within = within.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), F.col("a.n").alias("shared"), F.col("a.n").alias("total"))
    return across.filter("key_a < key_b").unionByName(within).distinct()


def similar_links(df: DataFrame, key: str, tokens: str, least: int = 5, percent: int = 60) -> DataFrame:
    """One row for each record with enough tokens: (key, class_id, copies, links).

    ``class_id`` is the smallest key with an equal set, ``copies`` the size of that class and
    ``links`` the number of records with a different but similar set.  Copies are never expanded
    into pairs, so a set that a third of all records share costs one row for each of them.
    """
    records = cut(set_records(df, key, tokens, least).filter(F.col("key").isNotNull()))
    classes = cut(set_classes(records))
    members = cut(records.join(classes, "tokens").select("key", F.col("rep").alias("class_id")))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    links = similar_classes(classes, percent)
    both = links.select(F.col("rep_a").alias("class_id"), F.col("rep_b").alias("to")).unionByName(links.select(F.col("rep_b").alias("class_id"), F.col("rep_a").alias("to")))
    degree = both.join(sizes.select(F.col("class_id").alias("to"), F.col("copies").alias("n")), "to").groupBy("class_id").agg(F.sum("n").alias("links"))
    return members.join(sizes, "class_id").join(degree, "class_id", "left").select("key", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
