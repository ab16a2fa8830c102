import random

from inkstone.llm import sharding as S


def brute(sizes, shards):
    def cuts(capacity):
        used, starts = 0, []
        for i, x in enumerate(sizes):
            if x > capacity:
                return None
            if used + x > capacity:
                starts.append(i)
                used = 0
            used += x
        return starts if len(starts) < shards else None

    capacity = max(sizes)
    while (found := cuts(capacity)) is None:
        capacity += 1
    return capacity, found + [len(sizes)] * (shards - 1 - len(found))


def runs(sizes, first, count, each):
    out, before = [], sum(sizes[:first])
    for a in range(first, first + count, each):
        part = sizes[a : min(a + each, first + count)]
        out.append(S.Run(a, len(part), before, before + sum(part), max(part)))
        before += sum(part)
    return out


def test_refined_search_equals_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        sizes = [rng.choice([1, 2, 3, 5, 50, rng.randint(1, 9)]) for _ in range(rng.randint(1, 60))]
        shards, each, pieces = rng.randint(1, 8), rng.randint(1, 20), rng.randint(2, 5)
        finer = lambda rs: [x for r in rs for x in runs(sizes, r.first, r.count, -(-r.count // pieces))]  # noqa: B023, E731
        assert S.minimax(runs(sizes, 0, len(sizes), each), shards, finer) == brute(sizes, shards)


def test_equal_texts_share_a_shard_and_slots_have_no_gaps(spark):
    rows = S.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    shards, texts = {}, {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
        texts.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in texts.values())


def test_query_has_the_least_capacity(spark):
    from inkstone.llm import sharding

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = sharding.op6_sharding(spark, d).collect()
    groups = {}
    for i in sorted(texts):
        groups.setdefault(texts[i], []).append(i)
    sizes = [len(ids) * (len(t.encode()) + 1) for t, ids in groups.items()]

    def shards(capacity):
        n, held = 1, 0
        for s in sizes:
            n, held = (n, held + s) if held + s <= capacity else (n + 1, s)
        return n

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= sharding.SHARDS)
    totals, shard = {}, {}
    for r in rows:
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["size"]
        shard.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    order = [min(shard[t]) for t in groups]
    assert max(totals.values()) == least and order == sorted(order) and all(len(s) == 1 for s in shard.values())
