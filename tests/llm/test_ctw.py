import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from inkstone.llm import ctw as C


class Node:
    def __init__(self):
        self.zeros = self.ones = 0
        self.kt = self.weight = 0.0
        self.children = {}


def brute(train, test, depth):
    """Sequential context-tree weighting with dictionaries."""
    trees = defaultdict(Node)

    def decisions(text):
        context = [10] * depth
        for byte in b" ".join(C.tokens(text)[:-1]) + b"\n":
            prefix = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield prefix, list(reversed(context))[:depth], bit
                prefix = prefix * 2 + bit
            context.append(byte)

    def kt(node, bit):
        return ((node.ones if bit else node.zeros) + 0.5) / (node.zeros + node.ones + 1)

    def learn(node, context, bit):
        node.kt += math.log(kt(node, bit))
        node.ones, node.zeros = node.ones + bit, node.zeros + 1 - bit
        if context:
            learn(node.children.setdefault(context[0], Node()), context[1:], bit)
            node.weight = np.logaddexp(node.kt, sum(c.weight for c in node.children.values())) - math.log(2)
        else:
            node.weight = node.kt

    def predict(node, context, bit):
        if node is None:
            return 0.5
        if not context:
            return kt(node, bit)
        stop = math.exp(node.kt - math.log(2) - node.weight)
        return stop * kt(node, bit) + (1 - stop) * predict(node.children.get(context[0]), context[1:], bit)

    for t in train:
        for prefix, context, bit in decisions(t):
            learn(trees[prefix], context, bit)
    return [sum(math.log10(predict(trees.get(p), c, b)) for p, c, b in decisions(t)) for t in test]


def test_scores_equal_sequential_weighting_whatever_is_broadcast(spark):
    texts = ["The then theater", "", None, "cat the é a a the cat", "the dog zzzzzz", "theatre  cat\n the éa", "x"]
    df = spark.createDataFrame([(i, t, i < 4) for i, t in enumerate(texts)], "doc_id long, text string, trains boolean")
    for depth in (4, 6):
        want, first = brute(texts[:4], texts, depth), None
        for words, grams in ((1 << 17, 1 << 21), (2, 10), (0, 0)):
            got = {r["doc_id"]: r["score"] for r in C.scored(df, "trains", depth=depth, most_words=words, most_grams=grams).collect()}
            assert all(abs(got[i] - w) < 1e-5 for i, w in enumerate(want))
            first = first or got
            assert all(abs(got[i] - first[i]) < 1e-12 for i in got)


def test_stretches_of_groups_change_nothing(spark, monkeypatch):
    texts = ["the cat and the dog " * 3, "another text altogether", "the dog"]
    df = spark.createDataFrame([(i, t, i < 2) for i, t in enumerate(texts)], "doc_id long, text string, trains boolean")
    whole = sorted((r["doc_id"], r["score"]) for r in C.scored(df, "trains").collect())
    monkeypatch.setattr(C, "HELD_GRAMS", 3)
    assert all(a == b and abs(x - y) < 1e-9 for (a, x), (b, y) in zip(whole, sorted((r["doc_id"], r["score"]) for r in C.scored(df, "trains").collect()), strict=True))


def test_deeper_contexts_score_held_out_rows_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (C.fold("doc_id", 7) != 2).alias("trains"))
    totals = [sum(r["score"] for r in C.scored(docs, "trains", depth=d).collect() if not r["trains"]) for d in (3, 4, 6)]
    assert totals[0] < totals[1] < totals[2]


def test_base_columns_and_gain_on_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = C.op8_ctw(spark, d).collect()
    docs = {r["doc_id"]: C.tokens(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    counts = Counter(w for r in rows if not r["held_out"] for w in docs[r["doc_id"]])
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        words = docs[r["doc_id"]]
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in counts for w in words) and r["train_tokens"] == total
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(-r["score"] for r in held) / math.log10(2) / sum(r["n_bytes"] for r in held) < 3.0


def test_gram_table():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 40, 5000))
    values = rng.random(len(codes))
    table = C.GramTable(codes, values)
    asked = np.concatenate([codes[::3], rng.integers(1 << 41, 1 << 42, 1000)])
    found, absent = table.find(asked)
    assert np.array_equal(found[: len(codes[::3])], values[::3]) and np.array_equal(np.sort(absent), np.arange(len(codes[::3]), len(asked)))


def test_blocks_are_as_small_as_asked():
    """Lookups take shorter stretches of text than counting: their memory is some hundred bytes a letter."""
    batch = pa.RecordBatch.from_pydict({"text": ["ab " * 100] * 50, "id": list(range(50))})
    sizes = [sum(len(x) for x in lists) for _, lists in C._blocks(iter([batch]), 1000)]
    assert len(sizes) == 13 and max(sizes) <= 4 * 101
    assert C.LOOKED_UP_BYTES <= 1 << 18
