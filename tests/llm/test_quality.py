from inkstone.llm import quality as Q


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = [i for i, r in enumerate(runs) if runs.count(r) > 1]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({i + k for i in twice for k in range(8)})


def test_measures_equal_brute_force(spark):
    texts = [None, "", "a b c d e f g h", "a b c d e f g h " * 3, "x\ny\nx\n\n \nx", "# one $ two three 👍 é\x0bq", "w " * 50, "a b c d e f g h i a b c d e f g h j k"]
    got = {r["i"]: r for r in Q.ledger(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i").collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t


def test_no_python_in_the_plan(spark):
    plan = Q.op5_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "fail_bits long")
    assert Q.apply_policy(rows, Q.BASE).filter("kept").count() == 2
    found = {r["rule"]: tuple(r)[1:] for r in Q.ablation(rows, Q.BASE).collect()}
    assert found == {"too_few_words": (3, 2, 4), "repeated_windows": (1, 0, 2)}
