"""Mixing sources to target shares by min-cost flow over membership patterns."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import cut

#: Hash buckets of the seeded order over all patterns; the bucket where a quota ends is ordered exactly.
BUCKETS = 65_536
#: Membership patterns whose plan is broadcast; where there are more, it is joined by shuffle.
PATTERNS = 4_096
#: Contents of several sources that are broadcast, some ten MB; where there are more, they are joined by shuffle.
SHARED = 100_000


class Flow:
    """Largest flow of supplies to the quotas of sources, kept as what every source holds of each supply.

    A supply serves some of the sources.  It waits at a place of its own until it moves to a source,
    from which another supply may move on to a further one, and so on up to a source whose quota is
    open: paths run over the sources alone, however many supplies there are.  What has been placed
    stays placed, and what found no path never finds one later, so supplies that are added and run
    in the order of their costs give the flow of least cost.
    """

    def __init__(self, quotas: list[int]) -> None:
        self.open = list(quotas)
        self.serves: list[tuple[int, ...]] = []
        self.held: dict[tuple[int, int], int] = {}  # (supply, place): amount; the last place is the waiting one
        #: Supplies at a place that also serve another one; those that have left are dropped when met.
        self.moves: list[list[list[int]]] = [[[] for _ in quotas] for _ in range(len(quotas) + 1)]
        self.reached: set[int] = set()

    def add(self, serves: tuple[int, ...], amount: int) -> int:
        self.serves.append(serves)
        self._put(len(self.serves) - 1, len(self.open), amount)
        return len(self.serves) - 1

    def _put(self, supply: int, place: int, amount: int) -> None:
        if (supply, place) not in self.held:
            for to in self.serves[supply]:
                if to != place:
                    self.moves[place][to].append(supply)
        self.held[supply, place] = self.held.get((supply, place), 0) + amount

    def _next(self, place: int, to: int) -> int | None:
        waiting = self.moves[place][to]
        while waiting and (waiting[-1], place) not in self.held:
            waiting.pop()
        return waiting[-1] if waiting else None

    def _path(self) -> list[int]:
        """The places from the waiting one to the nearest source with an open quota, or none."""
        start = len(self.open)
        via, line = {start: start}, [start]
        for place in line:
            for to in range(len(self.open)):
                if to not in via and self._next(place, to) is not None:
                    via[to] = place
                    line.append(to)
                    if self.open[to] > 0:
                        path = [to]
                        while path[-1] != start:
                            path.append(via[path[-1]])
                        return path[::-1]
        self.reached = set(via)
        return []

    def run(self) -> None:
        while path := self._path():
            steps = list(pairwise(path))
            while self.open[path[-1]] > 0:
                moved = [self._next(*step) for step in steps]
                if None in moved:
                    break
                amount = min(self.open[path[-1]], *(self.held[v, place] for v, (place, _) in zip(moved, steps)))
                for v, (place, to) in zip(reversed(moved), reversed(steps)):
                    self.held[v, place] -= amount
                    if not self.held[v, place]:
                        del self.held[v, place]
                    self._put(v, to, amount)
                self.open[path[-1]] -= amount


def plan(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], list[int]]:
    """Tokens that each source takes of each membership pattern, where it takes any: {(pattern, source): by repetition}.

    ``patterns`` maps the sources a document belongs to to the tokens of such documents.  The r-th
    use of a document costs r, so repetition is convex and spread evenly.  Without ``total`` the
    largest size is found at which every source that has documents reaches its share within its
    repetitions (sources without documents are left out and the others keep their proportions): some
    sources that miss their quotas hold all that may serve them, which bounds the size anew.
    """
    reach = {s for p, n in patterns.items() if n > 0 for s in p}
    live = {s: t for s, t in targets.items() if s in reach and t[0] > 0 and t[1] > 0}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())

    names = sorted(live)
    at_hand = [(p, n, [(i, live[s][1]) for i, s in enumerate(names) if s in p]) for p, n in sorted(patterns.items()) if n > 0]
    passes = max(most for _, most in live.values())

    def quotas(size: int) -> list[int]:
        return [int(size * live[s][0] / whole) for s in names]

    def serving(uses: list[tuple[int, int]], r: int) -> tuple[int, ...]:
        return tuple(i for i, most in uses if r < most)

    if total is None:
        supplies: Counter[tuple[int, ...]] = Counter()
        for _, n, uses in at_hand:
            ends = sorted({0, *(most for _, most in uses)})
            for r, end in pairwise(ends):
                supplies[serving(uses, r)] += n * (end - r)
        total = sum(supplies.values())
        while total > 0:
            flow = Flow(quotas(total))
            for serves, n in supplies.items():
                flow.add(serves, n)
            flow.run()
            if not any(flow.open):
                break
            short = [i for i in range(len(names)) if i not in flow.reached]
            has = sum(q - left for i, (q, left) in enumerate(zip(quotas(total), flow.open)) if i not in flow.reached)
            total = bisect_right(range(total), has, key=lambda size: sum(quotas(size)[i] for i in short)) - 1
    flow, meant = Flow(quotas(total)), []
    for r in range(passes):
        for k, (_, n, uses) in enumerate(at_hand):
            if serves := serving(uses, r):
                flow.add(serves, n)
                meant.append((k, r))
        flow.run()
        if not any(flow.open):
            break
    out: dict[tuple[tuple[str, ...], str], list[int]] = {}
    for (supply, place), amount in sorted(flow.held.items()):
        if place < len(names):
            k, r = meant[supply]
            out.setdefault((at_hand[k][0], names[place]), [0] * live[names[place]][1])[r] = amount
    return out


def with_sources(documents: DataFrame, content: str, source: str, targets: DataFrame) -> DataFrame:
    """Add ``sources``: the document's own source and every target under which equal content stands.

    ``content`` is a digest of what a document holds, null for nothing.  A document without a source
    belongs to none, whatever else holds its content.  Only contents of two or more sources are
    joined back, and they are few where sources are.
    """
    names = F.broadcast(targets.select(F.col("source").alias(source)).filter(F.col(source).isNotNull()).distinct())
    known = documents.filter(F.col(content).isNotNull()).select(content, source).join(names, source)
    several = cut(known.groupBy(content).agg(F.array_sort(F.collect_set(source)).alias("sources")).filter(F.size("sources") > 1))
    several = F.broadcast(several) if several.count() <= SHARED else several
    own = F.array_compact(F.array(source))
    joined = documents.drop("sources").join(several, content, "left")
    return joined.withColumn("sources", F.when(F.col(source).isNull(), own).otherwise(F.coalesce(F.array_union(own, "sources"), own)))


def membership(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``pattern``: the target sources a document belongs to, sorted; it may be empty."""
    names = [r["source"] for r in targets.select("source").filter("source is not null").distinct().collect()]
    return sizes.withColumn("pattern", F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isin(names)))))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None) -> DataFrame:
    """(key, source, tokens, uses): how often each chosen document is used for which source.

    ``sizes`` has key, tokens and sources (ARRAY of the sources the document belongs to), ``targets``
    source, target_share and max_repeats, a fixed short list.  Documents are aggregated by membership
    pattern, the flow routes pattern tokens to source quotas, and each pattern's flow is filled with
    documents in an order seeded by ``seed``: all documents r times, and one more time those that come
    first, up to the quota; the last one is taken if it fits by more than half.  Documents of a pattern
    that serves several sources are handed out to them one after the other, so no document's uses
    exceed the flow's.  A content that stands under several keys is a document each time, so a text of
    ``k`` copies may be used ``k`` times its repeats.  Documents of no source, of an unknown one or without tokens are not used;
    null tokens count as 0; a repeated row is a document of its own.
    """
    spark = sizes.sparkSession
    coded = membership(sizes, targets).select("key", F.coalesce("tokens", F.lit(0)).alias("tokens"), "pattern")
    coded = coded.filter("size(pattern) > 0 and tokens > 0").withColumn("name", F.concat_ws("\x1f", "pattern"))
    coded = cut(coded)
    # One row for each pattern that occurs; all of them are planned with.
    weights = {tuple(r["pattern"]): int(r["n"]) for r in coded.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source is not null and target_share is not null and max_repeats is not null").collect()}
    flows = plan(weights, goal, total)
    buckets = max(16, BUCKETS // max(1, len(weights)))
    coded = coded.withColumn("mixed", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.pmod("mixed", F.lit(buckets)))
    # The r-th pass over a pattern is a line from 0 to its tokens; sources take stretches of it in turn.
    stretches = []
    takers: dict[tuple[str, ...], dict[str, list[int]]] = defaultdict(dict)
    for (pattern, source), amounts in flows.items():
        takers[pattern][source] = amounts
    for pattern, mine in takers.items():
        for r in range(max(map(len, mine.values()), default=0)):
            at = 0
            for source in sorted(mine):
                if r < len(mine[source]) and mine[source][r] > 0:
                    stretches.append(("\x1f".join(pattern), r, source, at, at + mine[source][r]))
                    at += mine[source][r]
    if not stretches:
        return coded.filter("false").select("key", F.lit("").alias("source"), "tokens", F.lit(0).cast("long").alias("uses"))
    parts = spark.createDataFrame(stretches, "name string, pass int, source string, low long, high long")
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = coded.groupBy("name", "bucket").agg(F.sum("tokens").alias("n")).select("name", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("name", "bucket").orderBy("mixed", "key").rowsBetween(Window.unboundedPreceding, -1)
    few = F.broadcast if len(weights) <= PATTERNS else lambda df: df
    placed = coded.join(few(starts), ["name", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    middle = F.col("at") + F.col("tokens") / 2
    used = placed.join(few(parts), "name").filter((middle > F.col("low")) & (middle <= F.col("high")))
    return used.groupBy("key", "source", "tokens").agg(F.count("*").alias("uses"))


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: documents and tokens at hand, documents used, tokens taken, share reached."""
    have = membership(sizes, targets).filter("tokens > 0").select(F.explode("pattern").alias("source"), "tokens").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    got = mixed.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("tokens") * F.col("uses")).alias("taken"), F.max("uses").alias("most_uses"))
    rows = targets.select("source", "target_share", "max_repeats").join(F.broadcast(have), "source", "left").join(F.broadcast(got), "source", "left")
    rows = rows.fillna(0, ["documents", "tokens", "used_documents", "taken", "most_uses"])
    total = Window.partitionBy(F.lit(0))
    return rows.withColumn("reached_share", F.when(F.sum("taken").over(total) > 0, F.col("taken") / F.sum("taken").over(total)))
