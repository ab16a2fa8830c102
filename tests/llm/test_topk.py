"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from inkstone.llm import topk
from tests.llm.data import tables


def brute(rows: list[tuple], k: int, every: int) -> list[tuple]:
    """rows (id or None, integers); repeated queries are one."""
    out = []
    for own, q in sorted({(i, tuple(v)) for i, v in rows if i is not None and math.fmod(i, every) == 0}):
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), i is None, i or 0, i) for i, v in rows if i != own]
        out += [(own, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, rows, k=5, every=50, **how):
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "id long, v array<long>").repartition(4)
    return sorted((tuple(r) for r in topk.top_k(df.filter(f"id % {every} = 0"), df, k, **how).select("query_id", "rank", "id", "score").collect()), key=str)


@pytest.mark.parametrize("scale", [1, 5000, 1 << 20])
def test_clusters_ties_and_blocks(spark, scale):
    rng = np.random.default_rng(7)
    centres = rng.integers(-60, 60, (6, 8))
    rows = [(i, (centres[i % 6] + rng.integers(-3, 4, 8)) * scale) for i in range(700)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(None, rows[3][1]), (7, rows[7][1]), (50, rows[50][1])]  # ties, a null id, repeated rows
    assert found(spark, rows, block=4, stripe=30, pivots=8) == brute(rows, 5, 50)


def test_lengths_far_outliers_and_few_rows(spark):
    rows = [(0, [3, 4]), (1, [1]), (2, []), (50, [10**7, -(10**7), 5]), (3, [2, 2, 2]), (4, [0, 0, 0])]
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, rows[:1]) == []
    assert found(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_bounds_discard_in_clusters():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100, 100, (20, 8))
    v = np.concatenate([c + rng.integers(-2, 3, (200, 8)) for c in centres]).astype(np.int64)
    ids, pivots = np.arange(len(v)), v[::200]
    d = np.sqrt(((v[:, None] - pivots[None]) ** 2).sum(2)).astype(np.float32)
    own = slice(0, 4000, 400)
    search = topk.Search(v[own], d[own], (v**2).sum(1)[own], ids[own], 5, ids[::200], pivots)
    search.stream(v, d, (v**2).sum(1), ids, np.zeros(len(v), bool))
    assert search.evaluated < 0.5 * len(v) * 10
    for at, i in enumerate(ids[own]):
        scores = v @ v[i]
        want = sorted((-scores[j], j) for j in ids if j != i)[:5]
        assert [(-s, j) for s, j in zip(search.best[at][0], search.best[at][1], strict=True)] == want


def test_query_on_odd_rows(spark, tmp_path):
    at = tables(spark, tmp_path / "odd")
    floors = [(0, [256, -256, 128]), (50, [128, 64, 32]), (50, [128, 64, 32]), (4, []), (None, [256] * 3), (5, [0]), (-50, [2304000, 2304000, -2304000])]
    assert sorted((tuple(r) for r in topk.op11_topk(spark, at).collect()), key=str) == brute(floors, 5, 50)
