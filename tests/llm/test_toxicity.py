import itertools
import math
import random

import numpy as np

from inkstone.llm import toxicity as X


def test_marginals_equal_enumeration():
    rng = random.Random(2)
    for _ in range(100):
        chain = X.Chain(bias=rng.uniform(-3, 1), steps=np.array([[rng.uniform(-1, 1) for _ in (0, 1)] for _ in (0, 1)]))
        n = rng.randint(1, 8)
        places = sorted(rng.sample(range(n), rng.randint(1, n)))
        emissions = [rng.uniform(-2, 4) for _ in places]
        at, total, sums = dict(zip(places, emissions, strict=True)), 0.0, [0.0] * n
        for ys in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(at.get(i, chain.bias) * y for i, y in enumerate(ys)) + sum(chain.steps[a, b] for a, b in itertools.pairwise(ys)))
            total += w
            for i, y in enumerate(ys):
                sums[i] += w * y
        for p, m in zip(places, chain.marginals(places, emissions, n), strict=True):
            assert abs(m - sums[p] / total) < 1e-9


def test_gradient_is_that_of_the_likelihood():
    emit, steps, mask = np.array([[0.3, -1.0, 2.0]]), np.array([[0.1, -0.4], [0.7, 0.2]]), np.ones((1, 3), bool)
    marginal, pair, z = X.forward_backward(emit, steps, mask)
    for t in range(3):
        moved = emit.copy()
        moved[0, t] += 1e-6
        assert abs((X.forward_backward(moved, steps, mask)[2] - z) / 1e-6 - marginal[0, t]) < 1e-4
    moved = steps.copy()
    moved[1, 0] += 1e-6
    assert abs((X.forward_backward(emit, moved, mask)[2] - z) / 1e-6 - pair[1, 0]) < 1e-4


def test_learns_words_and_stems_from_labels(spark):
    rng = random.Random(1)
    plain = ["table", "river", "stone", "paper", "window", "garden", "letter"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vilx", "grump" + rng.choice(["a", "en", "ox", "ul"])]))
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = X.trained(X.sampled(df.filter("doc_id % 3 <> 0"), df.filter("doc_id % 3 <> 0").select("doc_id", "toxic")))
    found = {r["doc_id"]: r for r in X.scored(df, chain).collect()}
    held = [(found[i]["predicted"], y) for i, _, y in rows if i % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    text = "river stone vilx garden"
    spans = X.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), chain).first()["spans"]
    assert [text[s["from"] : s["to"]] for s in spans] == ["vilx"]


def test_held_out_accuracy_on_the_fixture(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in X.op1_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) >= 0.9


def test_windows_that_repeat_weigh_as_often():
    one = ([[0], [], [1]], [1, 0, 0])
    two = ([[], [1]], [0, 0])
    a = X.fitted([(*one, 3), (*two, 1)], 2, rounds=20)
    b = X.fitted([(*one, 1), (*one, 1), (*one, 1), (*two, 1)], 2, rounds=20)
    assert np.allclose(a[0], b[0]) and abs(a[1] - b[1]) < 1e-9 and np.allclose(a[2], b[2])


def test_query_equals_scores_text_by_text(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = X.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet").filter(X.fold("doc_id", X.FOLDS) != 0)
    chain = X.trained(X.sampled(docs, labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in X.op1_toxicity(spark, d).collect():
        assert abs(r["score"] - chain.score(*X.tagged(chain, texts[r["doc_id"]], {})[1:])) < 1e-9


def test_row_slopes_equal_enumeration():
    rng = np.random.default_rng(4)
    emit, steps, mask = rng.normal(size=(4, 3)), rng.normal(size=(2, 2)), np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 1, 1]], bool)
    emit *= mask
    rows, toxic, times = np.array([0, 0, 1, 2]), np.array([True, False, True]), np.array([2.0, 1.0, 3.0])

    def value(emit, steps):
        out = 0.0
        for g in range(3):
            total = zero = 1.0
            for w in np.flatnonzero(rows == g):
                n = int(mask[w].sum())
                paths = {ys: math.exp(sum(emit[w, i] * y for i, y in enumerate(ys)) + sum(steps[a, b] for a, b in itertools.pairwise(ys))) for ys in itertools.product((0, 1), repeat=n)}
                total, zero = total * sum(paths.values()), zero * paths[(0,) * n]
            out += times[g] * math.log((total - zero if toxic[g] else zero) / total)
        return out

    off, slope, told = X.row_slopes(emit, steps, mask, rows, toxic, times)
    assert abs(told - value(emit, steps)) < 1e-9
    for w, t in zip(*np.nonzero(mask), strict=True):
        moved = emit.copy()
        moved[w, t] += 1e-6
        assert abs((value(moved, steps) - told) / 1e-6 - off[w, t]) < 1e-4
    for s, r in itertools.product((0, 1), repeat=2):
        moved = steps.copy()
        moved[s, r] += 1e-6
        assert abs((value(emit, moved) - told) / 1e-6 - slope[s, r]) < 1e-4


def test_context_and_open_tags(spark):
    """Toxic is only one word right before another; each of both occurs as often in clean rows."""
    rng = random.Random(3)
    plain = ["table", "river", "stone", "paper", "window", "garden", "letter"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 40))]
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = ["vile", "hound"]
        else:
            words[3:3], words[8:8] = ["vile"], ["hound"]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("hold", X.fold("doc_id", 4) == 0)
    sample = X.sampled(df.filter("not hold"), df.select("doc_id", "toxic"))

    def accuracy(chain):
        got = X.scored(df.filter("hold"), chain).join(df.select("doc_id", "toxic"), "doc_id").collect()
        return sum(r["predicted"] == r["toxic"] for r in got) / len(got)

    both = X.trained(sample, context=True, open_tags=True)
    assert accuracy(both) == accuracy(X.trained(sample, context=True, open_tags=False)) == 1.0
    assert accuracy(X.trained(sample, context=False, open_tags=False)) < 0.9
    text = "vile river hound paper vile hound stone"
    assert [text[s["from"] : s["to"]] for s in X.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), both).first()["spans"]] == ["hound"]
