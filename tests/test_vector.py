"""Lists and tiles of vectors: exact whatever their number, approximate with known recall."""

import numpy as np
import pytest

from inkstone.operators import vector as V


@pytest.fixture(scope="module")
def table(spark):
    """Clusters, copies, a zero vector and none."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = [centres[i % 12] + rng.normal(size=16) * 0.5 for i in range(900)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[i].tolist()) for i in range(20)] + [(2002, [0.0] * 16), (2001, None)]
    unit = {i: np.array(x) / max(np.linalg.norm(x), 1e-300) for i, x in rows if x}
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5), sorted(unit), np.stack([unit[i] for i in sorted(unit)])


@pytest.mark.parametrize(("least", "tile"), [(0.7, 8192), (0.7, 100), (0.4, 100), (-0.2, 150)])
def test_pairs_of_tiles(table, least, tile):
    df, ids, m = table
    s = m @ m.T
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= least - 1e-12), strict=True) if i < j}
    found = [(r["a"], r["b"]) for r in V.similar_pairs(df, least, tile).collect()]
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize(("k", "capacity"), [(3, 65536), (3, 60), (40, 60)])
def test_search_in_lists(table, monkeypatch, k, capacity, own):
    df, ids, m = table
    monkeypatch.setattr(V, "QUERIES", 20)  # several blocks of questions for a list
    want = {}
    for at, i in enumerate(ids):
        if i % 7 == 0:
            order = sorted((-round(float(s), 9), j) for j, s in zip(ids, m @ m[at], strict=True) if own or j != i)[:k]
            want |= {(i, place + 1): j for place, (_, j) in enumerate(order)}
    questions = df.filter("id % 7 = 0")
    assert {(r["query_id"], r["place"]): r["id"] for r in V.top_k(questions, df, k, own, capacity=capacity).collect()} == want
    if capacity == 60:
        near = {(r["query_id"], r["id"]) for r in V.top_k(questions, df, k, own, probes=2, capacity=capacity).collect()}
        assert len(near & {(q, i) for (q, _), i in want.items()}) >= 0.9 * len(want)


def test_the_plan_does_not_grow_with_questions(table):
    df, _, _ = table
    few, many = (V.top_k(df.filter(f), df, 3, capacity=200)._jdf.queryExecution().analyzed().toString().count("\n") for f in ("id < 10", "id >= 0"))
    assert few == many


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert V.similar_pairs(none).count() == V.top_k(none, none).count() == V.top_k(one, none).count() == V.top_k(none, one).count() == V.similar_pairs(one).count() == 0
    assert V.top_k(one, one).first()["place"] == 1
