"""Filling containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import cut, tasks

#: Pieces that one shard packs on its own; shards are cut by hash, so their number follows the input.
SHARD_ITEMS = 20_000
#: Containers of a shard emptier than this share are opened again and packed in the next round.
REOPEN_BELOW = 0.97


class Packer:
    """Open containers by residual gap; each item goes where the squared counts become smallest."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # containers by gap; gap 0 is full and not counted
        self.by_gap: dict[int, list[int]] = {}
        self.used: list[int] = []

    def place(self, size: int) -> int:
        """Container number for an item of 1 .. capacity tokens.

        Moving a container from gap g to g - size changes the sum of squares by
        2 (N[g - size] - N[g]) + 2, without the first term's part where it becomes full; a new
        container changes it by 2 N[capacity - size] + 1.  Ties fall to the smallest gap.
        """
        counts, capacity = self.open, self.capacity
        gaps = counts[size:capacity]
        change = np.where(gaps > 0, 2 * (counts[: capacity - size] - gaps) + 2, np.iinfo(np.int64).max)
        if capacity > size and gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        fresh = 2 * counts[capacity - size] + 1 if size < capacity else 0
        best = int(np.argmin(change)) if len(change) else -1
        if best < 0 or change[best] > fresh or gaps[best] <= 0:
            number, gap = len(self.used), capacity
            self.used.append(0)
        else:
            gap = best + size
            number = self.by_gap[gap].pop()
            counts[gap] -= 1
        self.used[number] += size
        if left := gap - size:
            counts[left] += 1
            self.by_gap.setdefault(left, []).append(number)
        return number


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pack the shards of a partition that is sorted by kind and shard."""
    state: dict = {"key": None, "packer": None, "rows": []}

    def close() -> pd.DataFrame:
        packer, rows = state["packer"], state["rows"]
        out = [(*state["key"], item, tokens, number, packer.used[number]) for item, tokens, number in rows]
        return pd.DataFrame(out, columns=["pack_kind", "capacity", "shard", "item", "tokens", "container", "used"])

    for batch in batches:
        for key, rows in groupby(zip(batch["pack_kind"], batch["capacity"], batch["shard"], batch["item"], batch["tokens"]), key=lambda r: r[:3]):
            if key != state["key"]:
                if state["rows"]:
                    yield close()
                state.update(key=key, packer=Packer(int(key[1])), rows=[])
            for _, _, _, item, tokens in rows:
                state["rows"].append((item, tokens, state["packer"].place(int(tokens))))
    if state["rows"]:
        yield close()


SCHEMA = "pack_kind string, capacity int, shard long, item long, tokens long, container long, used long"


def _round(items: DataFrame, shards: int) -> DataFrame:
    """One round: items (pack_kind, capacity, item, mix, tokens) spread by ``mix`` over shards and packed there."""
    coded = items.withColumn("shard", F.pmod(F.xxhash64("mix"), F.lit(shards)))
    coded = coded.repartition(tasks(items.sparkSession), "pack_kind", "shard").sortWithinPartitions("pack_kind", "shard", "mix", "item")
    return coded.mapInPandas(_pack, SCHEMA)


def pack(sizes: DataFrame, kinds: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack_kind, key, piece, start_token, tokens, container) for every text and container kind.

    ``sizes`` has key (BIGINT) and tokens, ``kinds`` pack_kind and capacity_tokens (a few rows, kept
    on every task).  A text is cut only if it exceeds the capacity, into full containers and a
    remainder.  Texts without tokens (null or empty) lie in their kind's container -1, which holds
    nothing.  Kinds without a positive capacity and rows with a null key get no containers; a
    key that occurs twice is packed twice.

    Shards of at most about ``shard_items`` pieces are packed on their own by the sum-of-squares
    rule.  What lies in containers filled below ``REOPEN_BELOW`` is packed once more, all shards'
    leftovers together in as few shards as hold ``shard_items`` each; a container only ever moves
    whole, as one item, so nothing is cut again.
    """
    wanted = kinds.filter("pack_kind is not null and capacity_tokens > 0").select("pack_kind", F.col("capacity_tokens").alias("capacity")).distinct()
    wide = sizes.filter("key is not null").select("key", F.coalesce("tokens", F.lit(0)).alias("size")).join(F.broadcast(wanted))
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1, F.lit(0))
    cuts = wide.select("pack_kind", "capacity", "key", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * F.col("capacity")
    cuts = cuts.select("pack_kind", "capacity", "key", "piece", start.alias("start_token"), F.least(F.col("capacity").cast("long"), F.col("size") - start).alias("tokens"))
    cuts = cut(cuts.withColumn("item", F.monotonically_increasing_id()).withColumn("mix", F.xxhash64("key", "piece")))
    filled = cuts.filter("tokens > 0")
    most = filled.groupBy("pack_kind").count().agg(F.max("count")).first()[0] or 0
    shards = max(1, -(-most // shard_items))
    first = cut(_round(filled.select("pack_kind", "capacity", "item", "mix", "tokens"), shards))
    named = first.withColumn("box", F.col("shard") * F.lit(1 << 32) + F.col("container"))
    if shards > 1:
        loose = named.filter(F.col("used") < F.col("capacity") * REOPEN_BELOW)
        boxes = cut(loose.select("pack_kind", "capacity", F.col("box").alias("item"), F.xxhash64("box").alias("mix"), F.col("used").alias("tokens")).distinct())
        most = boxes.groupBy("pack_kind").count().agg(F.max("count")).first()[0] or 0
        again = _round(boxes, max(1, -(-most // shard_items)))
        again = again.select("pack_kind", F.col("item").alias("box"), (F.lit(1 << 62) + F.col("shard") * F.lit(1 << 32) + F.col("container")).alias("moved"))
        named = named.join(again, ["pack_kind", "box"], "left").withColumn("box", F.coalesce("moved", "box"))
    placed = cuts.join(named.select("item", "box"), "item", "left")
    return placed.select("pack_kind", "key", "piece", "start_token", "tokens", F.coalesce("box", F.lit(-1)).alias("container"))


def report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row for each kind: texts, pieces, containers, tokens, space and the share of space left unused."""
    boxes = packed.groupBy("pack_kind", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("texts"))
    totals = boxes.groupBy("pack_kind").agg(F.sum("texts").alias("texts"), F.sum("pieces").alias("pieces"), F.sum(F.when(F.col("container") >= 0, 1).otherwise(0)).alias("containers"), F.sum("used").alias("tokens"))
    totals = kinds.select("pack_kind", "capacity_tokens").join(totals, "pack_kind", "left").fillna(0, ["texts", "pieces", "containers", "tokens"])
    space = F.col("containers") * F.col("capacity_tokens")
    return totals.select("pack_kind", "capacity_tokens", "texts", "pieces", "containers", "tokens", space.alias("space"), F.when(space > 0, 1 - F.col("tokens") / space).alias("unused_share"))
