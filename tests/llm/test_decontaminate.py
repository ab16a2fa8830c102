import random

from inkstone.llm import decontaminate as D
from tests.llm.data import PASSAGE


def brute(items, doc, window):
    hit, found = set(), set()
    for k, (_, words) in enumerate(items):
        for x in [words[i : i + window] for i in range(len(words) - window + 1)] if len(words) >= window else [words]:
            for i in range(len(doc) - len(x) + 1):
                if doc[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(k)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        letters = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        items = [(str(k), [rng.choice(letters) for _ in range(rng.randint(1, 9))]) for k in range(rng.randint(0, 4))]
        window, doc = rng.randint(1, 5), [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 30))]
        spans, found = D.SuffixAutomaton(items, window).scan(doc)
        assert ({i for a, b in spans for i in range(a, b)}, found) == brute(items, doc, window)


def test_blocks_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(str, D.matched(docs, bench).select("doc_id", "_spans", "_items", "_n_words").collect()))
    assert sorted(map(str, D.matched(docs, bench, block_words=300).select("doc_id", "_spans", "_items", "_n_words").collect())) == want


def test_spans_are_cut_and_clean_rows_stay(spark):
    rows = [(1, f"Keep this. {PASSAGE.upper()}, and all of that which follows here in the text too, word by word to the end.", 5), (2, "clean text", 7), (3, PASSAGE, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    out = {r["doc_id"]: r for r in D.decontaminated(docs, bench).collect()}
    assert set(out) == {1, 2} and out[2]["text"] == "clean text" and out[2]["n_chars"] == 10
    assert out[1]["text"].startswith("Keep this. , and all") and out[1]["n_chars"] == len(out[1]["text"])
