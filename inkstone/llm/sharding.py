"""Minimax contiguous partition of atomic groups into shards.

Equal texts form a group, groups are ordered by their least id, and the shards are contiguous
runs of groups whose largest size is as small as possible. The smallest feasible capacity is
found by binary search with the greedy check (fill each shard while the next group fits).

The check needs prefix sums of all groups, which stay in a table. The driver holds at most
BLOCKS sums over runs of groups. A greedy cut that falls inside a run is only known to within
that run, so each check is made with the earliest and the latest cut; runs that leave a
capacity undecided are read again as finer runs (at most PIECES each), until the cuts are
exact. Memory on the driver is bounded by these two numbers and the number of shards and
partitions, whatever the number of groups.

Defined cases: null text has no bytes and equals the empty text; every row has size bytes + 1;
repeated rows get slots of their own; null ids come last; fewer groups than shards leave
later shards empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, joined_on_counted, stored, text_or_empty

SHARDS = 16
#: Most runs in the first summary, and most runs into which one run is split.
BLOCKS, PIECES = 4096, 512


@dataclass(frozen=True)
class Run:
    """Groups first .. first + count - 1 in order; start and end are sums of sizes before and through them."""

    first: int
    count: int
    start: int
    end: int
    most: int


class Cuts:
    """Greedy cuts over runs, as ranges of places that hold the true cut."""

    def __init__(self, runs: list[Run], shards: int) -> None:
        self.runs, self.shards = runs, shards
        self.ends = [r.end for r in runs]
        self.total = self.ends[-1]

    def after(self, at: int, capacity: int, late: bool) -> int:
        """Where a shard that starts at a sum ends: the latest or the earliest place that is possible."""
        k = bisect.bisect_right(self.ends, at + capacity)
        if k == len(self.runs):
            return self.total
        run = self.runs[k]
        if run.count == 1:
            return run.start
        return min(at + capacity, run.end) if late else max(run.start, at + capacity - run.most + 1)

    def places(self, capacity: int, late: bool) -> list[int]:
        out = [0]
        for _ in range(self.shards):
            out.append(self.after(out[-1], capacity, late))
        return out

    def fits(self, capacity: int, late: bool) -> bool:
        return self.places(capacity, late)[-1] >= self.total

    def least(self, late: bool) -> int:
        """Smallest capacity that the check allows; early cuts only ever ask for more."""
        low, high = max(r.most for r in self.runs), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, late) else (middle + 1, high)
        return low

    def undecided(self, low: int, high: int) -> list[int]:
        """Numbers of the runs of several groups that a cut may fall into for a capacity from low to high."""
        found: set[int] = set()
        for a, b in zip(self.places(low, late=False)[1:], self.places(high, late=True)[1:], strict=True):
            first, last = bisect.bisect_right(self.ends, a), bisect.bisect_right(self.ends, b)
            # a cut exactly at a run's end needs no look inside, unless an uncertain start led to it
            found |= {k for k in range(first, min(last, len(self.runs) - 1) + 1) if self.runs[k].count > 1 and self.runs[k].start <= b}
        return sorted(found)


def minimax(runs: list[Run], shards: int, finer: Callable[[list[Run]], list[Run]]) -> tuple[int, list[int]]:
    """Least capacity, and the number of the group that each shard but the first starts with (the count, past the end)."""
    groups = runs[-1].first + runs[-1].count
    while True:
        cuts = Cuts(runs, shards)
        low, high = cuts.least(late=True), cuts.least(late=False)
        open_runs = cuts.undecided(low, high)
        if not open_runs:
            starts = [r.start for r in runs]
            numbers = {s: r.first for s, r in zip(starts, runs, strict=True)} | {cuts.total: groups}
            return high, [numbers[p] for p in cuts.places(high, late=False)[1:shards]]
        again = set(open_runs)
        made = finer([runs[k] for k in open_runs])
        runs = sorted([*(r for k, r in enumerate(runs) if k not in again), *made], key=lambda r: r.first)


def _ranked(df: DataFrame, order: list[str], value: str, by: str | None = None) -> DataFrame:
    """df in the order of these columns with _n and _sum: row number and sum of value up to and with the row (within by, constant
    over stretches, if given). Two narrow passes around a range partitioning; the driver sees one row per partition and by."""
    spark = df.sparkSession
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = spread.withColumns({"_part": F.lit(0), "_n": F.lit(0).cast("long"), "_sum": F.lit(0).cast("long")}).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total, now = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            values = b.column(b.schema.get_field_index(value)).to_pylist()
            keys = b.column(b.schema.get_field_index(by)).to_pylist() if by else [0] * len(values)
            ns, sums = [], []
            for v, k in zip(values, keys, strict=True):
                if k != now:
                    n, total, now = 0, 0, k
                ns.append(n)
                n, total = n + 1, total + v
                sums.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(ns), pa.int32()), pa.array(ns, pa.int64()), pa.array(sums, pa.int64())], names=[*b.schema.names, "_part", "_n", "_sum"])

    local = stored(spread.mapInArrow(counted, schema), "ranked")
    key = F.col(by) if by else F.lit(0)
    held = local.groupBy("_part", key.cast("long").alias("_key")).agg((F.max("_n") + 1).alias("n"), F.max("_sum").alias("s")).collect()
    before: dict[int, tuple[int, int]] = {}
    rows = []
    for r in sorted(held):
        n, s = before.get(r["_key"], (0, 0))
        rows.append((r["_part"], r["_key"], n, s))
        before[r["_key"]] = (n + r["n"], s + r["s"])
    offsets = spark.createDataFrame(rows, "_part int, _key long, _n0 long, _s0 long")
    joined = local.withColumn("_key", key.cast("long")).join(offsets, ["_part", "_key"])
    return joined.withColumns({"_n": F.col("_n") + F.col("_n0"), "_sum": F.col("_sum") + F.col("_s0")}).drop("_part", "_key", "_n0", "_s0")


def _summary(groups: DataFrame, block) -> list[Run]:
    made = groups.groupBy(block.alias("_block")).agg(
        F.min("_n").alias("first"), F.count("_n").alias("count"), F.min(F.col("_sum") - F.col("total")).alias("start"), F.max("_sum").alias("end"), F.max("total").alias("most")
    )
    return sorted((Run(r["first"], r["count"], r["start"], r["end"], r["most"]) for r in made.collect()), key=lambda r: r.first)


def partitioned(rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, pieces: int = PIECES) -> DataFrame:
    """rows (id, size, key and whatever else) plus shard and slot: rows of one key share a shard."""
    spark = rows.sparkSession
    rows = stored(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = groups.withColumn("first", F.coalesce("first", F.lit((1 << 63) - 1)))
    groups = stored(_ranked(groups, ["first", "key"], "total"), "groups")
    n = groups.count()
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("key")

    def finer(runs: list[Run]) -> list[Run]:
        most = max(2, min(pieces, blocks * 8 // len(runs)))
        firsts, lasts, each = [r.first for r in runs], [r.first + r.count for r in runs], [-(-r.count // most) for r in runs]

        def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(0).to_pylist()
                own = [bisect.bisect_right(firsts, n) - 1 for n in at]
                kept = [i for i, (n, k) in enumerate(zip(at, own, strict=True)) if k >= 0 and n < lasts[k]]
                names = [own[i] * pieces + (at[i] - firsts[own[i]]) // each[own[i]] for i in kept]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(kept, pa.int64())).columns, pa.array(names, pa.int64())], names=["_n", "_sum", "total", "_block"])

        inside = groups.filter(F.col("_n").between(firsts[0], lasts[-1] - 1)).select("_n", "_sum", "total")
        return _summary(inside.mapInArrow(blocked, "_n long, _sum long, total long, _block long"), F.col("_block"))

    _, cuts = minimax(_summary(groups, F.floor(F.col("_n") / -(-n // blocks))), shards, finer)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_n") >= c).cast("int")
    # texts that repeat very often are joined by broadcast, so that no task gets all of their rows
    named = groups.select("key", F.col("_n").alias("_group"), shard.alias("shard"), "copies")
    placed = joined_on_counted(rows, named, "key", "copies", groups.agg(F.sum("copies")).first()[0])
    placed = placed.withColumn("_tie", F.monotonically_increasing_id()).drop("key")
    placed = stored(placed, "placed")
    return _ranked(placed, ["_group", "id", "_tie"], "size", by="shard").withColumnRenamed("_n", "slot").drop("_sum", "_group", "_tie")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")
    )
    return partitioned(rows).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
