"""Vector codes against a plain version; the search against all entries."""

import hashlib

import numpy as np

from inkstone.llm import codes
from tests.llm.data import tables


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))


def brute(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict, list]:
    """rows (id, integers), ids distinct."""
    width = -(-max(len(v) for _, v in rows) // parts)
    cut = {i: [[*v, *[0] * (width * parts - len(v))][m * width : (m + 1) * width] for m in range(parts)] for i, v in rows}
    books = [[cut[i][m] for i in sorted(cut)[:entries]] for m in range(parts)]
    for _ in range(rounds):
        for m in range(parts):
            members = {}
            for i in cut:
                members.setdefault(nearest(cut[i][m], books[m])[1], []).append(cut[i][m])
            for j, own in members.items():
                books[m][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = {}
    for i in cut:
        best = [nearest(cut[i][m], books[m]) for m in range(parts)]
        out[i] = (bytes(j for _, j in best), sum(d for d, _ in best))
    return out, books


def test_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-30, 30, 12)]) for i in range(400)]
    rows += [(500 + i, rows[i % 9][1]) for i in range(60)]  # copies: unused and equal entries
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "id long, v array<long>, label int").repartition(5)
    got, books = codes.compressed(df, parts=3, entries=20, rounds=3)
    want, wanted = brute(rows, 3, 20, 3)
    assert books.tolist() == wanted
    assert {r["id"]: (bytes(r["code"]), r["error"]) for r in got.collect()} == want


def test_equal_entries_go_to_the_lower_index():
    books = codes.Books(np.array([[[5, 5], [0, 0], [0, 0], [5, 5], [2, 0]]]))
    x = np.array([[[0, 0]], [[5, 5]], [[1, 0]], [[9, 9]]])
    for start in range(5):
        index, d, _ = books.search(x, np.full((4, 1), start))
        assert index.ravel().tolist() == [1, 0, 1, 0] and d.ravel().tolist() == [0, 0, 1, 32]


def test_search_skips_entries_beyond_the_radius():
    rng = np.random.default_rng(5)
    entries = rng.integers(-1000, 1000, (4, 64, 4))
    books = codes.Books(entries)
    x = np.stack([entries[np.arange(4), rng.integers(0, 64, 4)] + rng.integers(-20, 20, (4, 4)) for _ in range(300)])
    apart = ((x[:, :, None, :] - entries[None]) ** 2).sum(3)
    first, _, n_first = books.search(x, np.zeros((300, 4), np.int64))
    again, d, n_again = books.search(x, first)
    assert (first == apart.argmin(2)).all() and (again == first).all() and (d == apart.min(2)).all()
    assert n_again < 0.1 * n_first  # from the previous entry only a few neighbours are near enough


def test_query_on_odd_rows(spark, tmp_path):
    got = codes.op12_codes(spark, tables(spark, tmp_path / "odd")).collect()
    assert sorted((r["vec_id"] for r in got), key=str) == sorted([0, 50, 50, 4, None, 5, -50], key=str)
    assert {len(r["code"]) for r in got} == {32} and {r["error"] for r in got} == {0}
    # seven entries: each vector is its own entry until rounds floor the copies' mean, which is the vector
    books = [[-50, [2304000, 2304000, -2304000]], [0, [256, -256, 128]], [4, []], [5, [0]], [50, [128, 64, 32]], [50, [128, 64, 32]], [None, [256] * 3]]
    flat = [str((v + [0] * 16)[m]) for m in range(16) for _, v in books]
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(flat).encode()).hexdigest()}
