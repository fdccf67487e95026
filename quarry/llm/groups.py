"""Connected groups from pairwise ties: union-find in partitions, forests merged hierarchically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import cut, tasks

#: Forest edges that one task may hold: two 64-bit arrays and their index, below 200 MB.
FOREST_EDGES = 2_000_000
FAN_IN = 8


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the edges (a, b), as edges from each node to the smallest node of its tree."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    left, right = codes[: len(a)].tolist(), codes[len(a):].tolist()
    for x, y in zip(left, right):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):  # parents are smaller, so theirs are final already
        parent[i] = parent[p]
    root = np.asarray(parent, np.int64)
    child = np.flatnonzero(root != np.arange(len(root)))
    return nodes[child], nodes[root[child]]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of a partition; only the forest is kept between batches."""
    a = b = np.zeros(0, np.int64)
    new_a, new_b, waiting = [], [], 0
    for batch in batches:
        new_a.append(batch["a"].to_numpy(np.int64))
        new_b.append(batch["b"].to_numpy(np.int64))
        waiting += len(batch)
        if waiting > max(100_000, len(a)):
            a, b = _stars(np.concatenate([a, *new_a]), np.concatenate([b, *new_b]))
            new_a, new_b, waiting = [], [], 0
            if len(a) >= FOREST_EDGES:
                yield pd.DataFrame({"a": a, "b": b})
                a = b = np.zeros(0, np.int64)
    if waiting or len(a):
        a, b = _stars(np.concatenate([a, *new_a]), np.concatenate([b, *new_b]))
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Group of every node of ``edges`` (a, b: BIGINT): (node, group_id), the smallest node as group_id.

    Every partition reduces its edges to a spanning forest; forests are merged ``FAN_IN`` at a time
    while a merged one is sure to fit a task (``forest_edges``).  If they no longer fit, rounds in
    bounded partitions go on: union-find over the edges of each child, then every edge is led past its
    parent to the parent above, until no child has two parents and no parent is a child: exact
    for any number of edges.  Ties to a null node and loops
    tie nothing; repeated edges are harmless.  No step holds all edges in the driver.
    """
    schema = "a long, b long"
    clean = edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    forest = cut(clean.mapInPandas(_forest, schema))
    parts, held = forest.rdd.getNumPartitions(), forest.count()
    while parts > 1 and held * FAN_IN <= forest_edges * parts:
        parts = max(1, -(-parts // FAN_IN), -(-held // forest_edges))
        forest = cut(forest.coalesce(parts).mapInPandas(_forest, schema))
        held = forest.count()
        if parts == -(-held // forest_edges):
            break
    done = forest.rdd.getNumPartitions() <= 1 and held < FOREST_EDGES
    while not done:
        if held <= forest_edges:
            forest = cut(forest.coalesce(1).mapInPandas(_forest, schema))
            break
        parts = max(tasks(edges.sparkSession), -(-2 * held // forest_edges))
        forest = cut(forest.repartition(parts, "a").mapInPandas(_forest, schema))
        above = cut(forest.groupBy("a").agg(F.min("b").alias("up"), F.max("b").alias("other")))
        jumped = forest.join(above.select(F.col("a").alias("b"), "up"), "b", "left")
        if jumped.filter("up is not null").isEmpty() and above.filter("up <> other").isEmpty():
            break
        forest = cut(jumped.select("a", F.coalesce("up", "b").alias("b")).filter("a <> b").distinct())
        held = forest.count()
    stars = forest.distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("group_id")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("group_id"))).distinct()


def _key_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest over (node, key) edges of a partition: node ties, and one node for each key seen here."""
    first: dict[str, int] = {}

    def keys() -> pd.DataFrame:
        return pd.DataFrame({"key": list(first), "a": list(first.values()), "b": None}).astype({"b": "Int64"})

    for batch in batches:
        ties = [(None, n, r) for n, k in zip(batch["node"].tolist(), batch["key"].tolist()) if (r := first.setdefault(k, n)) != n]
        if ties:
            yield pd.DataFrame(ties, columns=["key", "a", "b"]).drop_duplicates().astype({"b": "Int64"})
        if len(first) > 300_000:
            yield keys()
            first = {}
    if first:
        yield keys()


def groups_by_keys(ties: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Groups of nodes that share keys, directly or through others: (node, group_id).

    ``ties`` has node (BIGINT) and key (STRING).  Partitions tie the nodes of a key among
    themselves first, so a key that a third of all rows hold leaves each with one row.  Nodes of no
    tie, null keys and null nodes do not come out.
    """
    seen = cut(ties.filter("node is not null and key is not null").select("node", "key").mapInPandas(_key_forest, "key string, a long, b long"))
    chain = Window.partitionBy("key").orderBy("a")
    across = seen.filter("key is not null").select("a", F.lag("a").over(chain).alias("b"))
    return components(seen.filter("key is null").select("a", "b").unionByName(across.filter("b is not null")), forest_edges)


# How the identifiers of a publication are written.
def doi_key(column: str):
    """A DOI without blanks, prefix, resolver address and closing punctuation, lower-cased; null if it names nothing."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)[\s\p{Cf}]+", "")), r"^(https?://[^/]+/|doi\.[a-z]+/|dx\.doi\.[a-z]+/)?(doi:)?(https?://[^/]+/)?", "")
    bare = F.regexp_replace(bare, r"[.,;:)\]}>\"'/]+$", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/.+"), F.concat(F.lit("doi:"), bare))


def arxiv_key(column: str):
    """An arXiv identifier without blanks, prefix, address, version and closing punctuation; null if it names nothing."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)[\s\p{Cf}]+", "")), r"^(https?://[^/]+/)?(abs/|pdf/)?(arxiv:)*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[.,;:)\]}>\"'/]+$", ""), r"\.pdf$", "")
    bare = F.regexp_replace(bare, r"v[0-9]+$", "")
    return F.when(bare.rlike(r"^([0-9]{4}\.[0-9]{4,5}|[a-z-]+(\.[a-z]{2})?/[0-9]{7})$"), F.concat(F.lit("arxiv:"), bare))


def journal_key(column: str):
    """Letters and digits of journal, volume and first page; null if one of them is missing."""
    parts = F.split(F.lower(F.col(column)), ",")
    clean = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), r"[^\p{L}\p{N}]+", "")
    page = F.regexp_extract(F.get(parts, F.lit(2)), r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1)
    return F.when((F.size(parts) >= 3) & (clean(0) != "") & (clean(1) != "") & (page != ""), F.concat_ws(",", F.lit("journal"), clean(0), clean(1), page))


def publication_groups(works: DataFrame, key: str = "work_id") -> DataFrame:
    """(work_id, group_id) of every record tied to another by doi, arxiv_id or journal_key."""
    keys = F.array_compact(F.array(doi_key("doi"), arxiv_key("arxiv_id"), journal_key("journal_key")))
    ties = works.select(F.col(key).cast("long").alias("node"), F.explode(keys).alias("key"))
    return groups_by_keys(ties).select(F.col("node").alias(key), "group_id")
