import itertools
import random

import numpy as np
import xxhash

from inkstone.llm import simhash as S
from tests.llm.data import python_words


def brute_fingerprint(text):
    words = python_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_equal_brute_force(monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 7)
    for t in (None, "", "a", "A b", "a b c", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i", " ".join(map(str, range(100))), "The cat sat on the mat and the cat sat", "é É ß x y z " * 50):
        assert S.fingerprint(t) == brute_fingerprint(t)


def test_links_equal_brute_force_with_and_without_tiles(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = roots(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    df = spark.createDataFrame([(x, x) for x in fps], "node long, fp long")
    for tile in (20_000, 5):
        found = {r["node"]: r["root"] for r in S.components(S.links(df, 2, tile)).collect()}
        assert [found.get(x, x) for x in fps] == [fps[w] for w in want]


def test_pivot_coordinates_bound_the_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        assert all(abs((a ^ p).bit_count() - (b ^ p).bit_count()) <= (a ^ b).bit_count() for p in S.PIVOTS)


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def five_word_sets(texts):
    split = [python_words(t) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_are_those_of_five_word_jaccard(spark):
    rng, texts = random.Random(11), []
    for _ in range(60):
        words = words_of(rng, rng.randint(3, 200))
        texts.append(" ".join(words))
        n = len(words)
        k = rng.randint(0, n // 5)
        texts.append(" ".join(words + words_of(rng, rng.randint(0, n // 3))))
        texts.append(" ".join(words[: n - k] + words_of(rng, k)))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(n)] = rng.choice(["changed", "and altered"])
        texts.append(" ".join(words))
    rng.shuffle(texts)
    sets = five_word_sets(texts)
    want = {i for i, r in enumerate(roots(sets, near)) if r == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (S.TILE, 4):
        assert {r["doc_id"] for r in S.deduplicated(docs, tile).collect()} == want


def test_sketches_never_reject_near_copies():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 63, 64, 65, 120, 1000, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: rng.integers(0, n + 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), dtype=np.uint64)]))
            near = S.alike(len(np.intersect1d(a, b)), len(a), len(b))
            assert S.sketches_allow(S.sketch(a), S.sketch(b), len(a), len(b)) or not near


def test_folded_fingerprints_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 3 :], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
        x, y = (np.frombuffer(S.folded(S.sketch(z)), np.uint8) for z in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_pairs_apart_equal_brute_force_with_and_without_tiles(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for key in range(12):
        base = np.unique(np.array([rng.getrandbits(62) for _ in range(60)], np.uint64))
        group = []
        for k in range(rng.choice([2, 2, 5, 40])):
            own = np.unique(np.concatenate([rng.sample(base.tolist(), 60 - rng.randint(0, 9)), [rng.getrandbits(62) for _ in range(rng.randint(0, 9))]]).astype(np.uint64))
            group.append((key * 100 + k, own, 7 if k > 6 else key * 100 + k))
        rows += [(key, node, len(own), 0, root, S.folded(S.sketch(own))) for node, own, root in group]
        for (a, x, r), (b, y, q) in itertools.combinations(group, 2):
            if r != q and S.alike(len(np.intersect1d(x, y)), len(x), len(y)):
                want.add((a, b))
    df = spark.createDataFrame(rows, "key long, node long, n long, at long, root long, fp binary")
    for tile in (20_000, 3):
        got = {(r["a"], r["b"]) for r in S.pairs_apart(df, tile).collect()}
        assert want <= got and all((a // 100) == (b // 100) for a, b in got) and len(got) < len(want) + 400


def test_no_verified_link_is_lost_in_groups_of_versions(spark):
    rng, texts = random.Random(5), []
    for _ in range(6):
        words = words_of(rng, 300)
        for _ in range(40):
            version = list(words)
            for at in rng.sample(range(300), rng.randint(3, 16)):
                version[at] = words_of(rng, 1)[0]
            texts.append(" ".join(version))
    sets = five_word_sets(texts)
    want = {i for i, r in enumerate(roots(sets, near)) if r == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (S.TILE, 4):
        assert {r["doc_id"] for r in S.deduplicated(docs, tile).collect()} == want


def test_cells_of_the_pivot_table_agree_for_near_fingerprints(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(50)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    rows = {r["node"]: r for r in S.pivot_table(df).collect()}
    for k, f in enumerate(fps):
        base = (f ^ S.PIVOTS[0]).bit_count()
        assert list(rows[k]["c"]) == [(f ^ S.PIVOTS[0] ^ (1 << (63 - i))).bit_count() - base for i in range(64)]
    for k in range(50):
        same = [rows[k]["c"][a:b] == rows[k + 50]["c"][a:b] for a, b in S.families(2)]
        assert sum(same) >= 2


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in S.op7_simhash(spark, d).collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    fps = np.array([brute_fingerprint(t) for _, t in texts], np.uint64)
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    for k, (doc, _) in enumerate(texts):
        assert got[doc]["fingerprint"] == f"{int(fps[k]):016x}" and got[doc]["component_id"] == texts[find(k)][0]
