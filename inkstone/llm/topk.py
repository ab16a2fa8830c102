"""Exact top-k search by inner product with a pivot table.

1. Pivots are rows of the table: of a bounded sample (the ``SAMPLE`` least hashes) those that lie
   farthest from the ones chosen before. The sample decides the order of work, never the result.
2. The pivot table holds every row's Euclidean distance to every pivot, computed once and stored.
3. By the triangle inequality the largest difference of two rows' distances to a pivot, L, bounds
   their distance from below, so their inner product is (|q|^2 + |x|^2 - L^2) / 2 at most. A query
   starts with its k-th best score among the pivots, drops what is bounded below it, and evaluates
   the rest in the order of their bounds, in stretches, until no bound reaches its k-th best score.
   Bounds are widened by the rounding of the stored distances; scores are exact integers.

Queries are a table like any other: blocks of ``BLOCK`` queries meet stripes of rows in one task
each, which holds its queries and streams the rows, so neither side is broadcast and a task's
memory depends on BLOCK alone. A task returns k rows a query at most.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors end in zeros; rows with a query's own id are not its candidates; repeated queries (same id
and vector) are one; repeated candidates are all ranked, null ids after others; ties go to smaller
ids; fewer candidates than k are all returned; an empty table gives no rows. Scores are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import integer_vectors, matrix, ship, stored, widest

PIVOTS, SAMPLE = 32, 2048
#: Queries of a block at most; rows of a stripe at least, and the number of stripes below which there are more of them.
BLOCK, STRIPE, STRIPES = 8192, 500, 64
LARGE_STRIPE = 1 << 20
#: Candidates of the first stretch that is evaluated; each further one has twice as many.
FIRST = 64
#: Partial sums of integers below these bounds are exact.
EXACT32, EXACT64 = 1 << 24, 1 << 53


def chosen_pivots(rows: DataFrame, width: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of so many rows with an id at most, each the farthest of the sample from those before it."""
    order = F.xxhash64("id", "v")
    some = rows.filter("id is not null").select("id", "v").dropDuplicates(["id"]).orderBy(order, "id").limit(sample).toArrow()
    ids, v = some["id"].to_numpy(), matrix(some["v"].combine_chunks(), width).astype(np.float64)
    near, taken = np.full(len(ids), np.inf), []
    while len(taken) < min(pivots, len(ids)):
        at = int(np.argmax(near))
        taken.append(at)
        near = np.minimum(near, ((v - v[at]) ** 2).sum(1))
        near[taken] = -1
    return ids[taken], v[taken].astype(np.int64)


def pivot_table(rows: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """rows with d, the distances to the pivots as floats, and norm, the squared length."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), width)
            d = np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in pivots], 1).astype(np.float64)).astype(np.float32) if len(v) else np.zeros((0, len(pivots)), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array((v**2).sum(1))], names=[*b.schema.names, "d", "norm"])

    return rows.mapInArrow(told, "id long, v array<long>, d array<float>, norm long")


class Search:
    """The k best of a block of queries so far."""

    def __init__(self, v: np.ndarray, d: np.ndarray, norm: np.ndarray, ids: np.ndarray, k: int, pivot_ids: np.ndarray, pivots: np.ndarray) -> None:
        self.v, self.d, self.norm, self.ids, self.k = v, d, norm, ids, k
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # no candidate below it is among the k best
        for at in range(len(ids)):
            scores = np.sort(pivots[pivot_ids != ids[at]] @ v[at])
            if len(scores) >= k:
                self.least[at] = scores[-k]
        none = np.empty(0, np.int64)
        self.best = [(none, none, none.astype(bool))] * len(ids)  # scores, ids, whether the id is null
        self.evaluated = 0

    def stream(self, v: np.ndarray, d: np.ndarray, norm: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        most = float(max(np.abs(self.norm).max(initial=0), 1)) ** 0.5 * float(max(norm.max(initial=0), 1)) ** 0.5
        kind = np.float32 if 2 * most < EXACT32 else np.float64 if 2 * most < EXACT64 else np.int64
        x, q, far = v.astype(kind), self.v.astype(kind), d.max(1, initial=0)
        for at, own in enumerate(self.ids):
            apart = np.abs(d - self.d[at]).max(1, initial=0).astype(np.float64)
            slack = (far.astype(np.float64) + float(self.d[at].max(initial=0))) ** 2 * 2.0**-22
            bound = (float(self.norm[at]) + norm - apart**2) / 2 + slack + 1e-6
            left = np.flatnonzero((bound >= self.least[at]) & (unknown | (ids != own)))
            left = left[np.argsort(-bound[left], kind="stable")]
            bound, done, step = bound[left], 0, FIRST
            while done < len(left) and bound[done] >= self.least[at]:
                some = left[done : done + step]
                self._take(at, np.rint(x[some] @ q[at]).astype(np.int64) if kind is not np.int64 else x[some] @ q[at], ids[some], unknown[some])
                self.evaluated += len(some)
                done, step = done + step, 2 * step

    def _take(self, at: int, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        good = scores >= self.least[at]
        if not good.any():
            return
        scores, ids, unknown = (np.concatenate([a, b[good]]) for a, b in zip(self.best[at], (scores, ids, unknown), strict=True))
        order = np.lexsort((ids, unknown, -scores))[: self.k]
        self.best[at] = scores[order], ids[order], unknown[order]
        if len(order) == self.k:
            self.least[at] = max(self.least[at], scores[order[-1]])

    def found(self) -> pa.RecordBatch:
        n = [len(s) for s, _, _ in self.best]
        scores, ids, unknown = (np.concatenate([b[i] for b in self.best] or [np.empty(0, np.int64)]) for i in range(3))
        row = np.repeat(np.arange(len(self.ids)), n)
        digest = [self.v[i].tobytes() for i in row]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row], pa.int64()), pa.array(digest, pa.binary()), pa.array(ids.astype(np.int64), pa.int64(), mask=unknown.astype(bool)), pa.array(scores.astype(np.int64), pa.int64())], names=["query_id", "q", "id", "score"])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the greatest inner product with each query, own id left out; both sides are
    (id, v array<long>), and queries are rows too or of the same kind. Query ids are not null."""
    rows = stored(rows.select("id", "v"), "integers")
    queries = stored(queries.filter("id is not null").select("id", "v").distinct(), "queries")
    width, n, asked = max(widest(rows), widest(queries)), rows.count(), queries.count()
    pivot_ids, points = chosen_pivots(rows, width, pivots)
    table = stored(pivot_table(rows, width, points), "pivot_table")
    asking = stored(pivot_table(queries, width, points), "query_table")
    blocks = max(1, -(-asked // block))
    stripes = max(1, min(STRIPES, n // stripe), n // LARGE_STRIPE)
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    own = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    asking = asking.select(F.lit(0).alias("kind"), own(blocks).alias("block"), every(stripes).alias("stripe"), "id", "v", "d", "norm")
    told = table.select(F.lit(1).alias("kind"), every(blocks).alias("block"), own(stripes).alias("stripe"), "id", "v", "d", "norm")
    # the tables and ids are evenly hashed, so blocks and stripes are even whatever the ids are
    met = asking.unionAll(told).repartition("block", "stripe").sortWithinPartitions("block", "stripe", "kind")

    def arrays(b: pa.RecordBatch) -> tuple:
        ids = b.column("id")
        return matrix(b.column("v"), width), matrix_of_floats(b.column("d"), len(points)), b.column("norm").to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, search = None, [], None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in ("block", "stripe", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if at != tuple(keys[a, :2]):
                    if search:
                        yield search.found()
                    at, waiting, search = tuple(keys[a, :2]), [], None
                part = arrays(whole.slice(a, z - a))
                if keys[a, 2] == 0:
                    waiting.append(part)
                elif waiting or search:
                    if search is None:
                        v, d, norm, ids, _ = (np.concatenate(x) for x in zip(*waiting, strict=True))
                        search, waiting = Search(v, d, norm, ids, k, pivot_ids, points), []
                    search.stream(*part)
        if search:
            yield search.found()

    hits = met.mapInArrow(searched, "query_id long, q binary, id long, score long")
    best = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def matrix_of_floats(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five rows of greatest integer inner product with every fiftieth row."""
    rows = stored(integer_vectors(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "whole")
    return top_k(rows.filter("id % 50 = 0"), rows).withColumnRenamed("id", "vec_id")


OP11_SQL = """
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM r q JOIN r c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
) WHERE rank <= 5
"""
