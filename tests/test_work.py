"""Work that must not be done a row, a term or a whole text at a time, with the results that it had."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import grounding, vector

SPACES = [chr(k) for k in range(0x3001) if chr(k).isspace()]
LETTERS = ["a", "Bc", "é", "K", "İ", "ẞx", "1", "of", "the", "_", "日本", ".", "!", "?", ". ", "\n", " ", "-"]


def odd_texts(n):
    rng = random.Random(5)
    return ["", " ", ". . .", None, *["".join(rng.choice(LETTERS + SPACES) for _ in range(rng.randrange(120))) for _ in range(n)]]


def test_letters_are_counted_for_many_texts_at_once():
    texts = [*odd_texts(2500), "x" * 5000]
    found = vector.letter_vectors(pd.Series(texts, dtype=object))
    for text, v in zip(texts, found, strict=True):
        counts = np.array([(text or "").lower().count(chr(97 + k)) for k in range(26)], np.float64)
        assert (v is None) if not counts.any() else np.array_equal(v, counts / np.sqrt((counts**2).sum()))


def test_texts_of_many_rows_are_embedded_together(spark):
    made = [(k, "Rebels crossed the river today. They were seen near the bridge. [Source 1]", [1]) for k in range(40)]
    sources = spark.createDataFrame([(k, 1, "Rebels crossed the river today. They were seen near the bridge.") for k in range(40) if k != 7], "draft_id long, source_id int, content string")

    def embed(texts):
        # 39 rows of four texts and one of two come in few batches: one row's alone are never given
        if len(texts) <= 4:
            raise ValueError("one row at a time")
        return vector.letter_vectors(texts)

    claims = grounding.claims(spark.createDataFrame(made, "draft_id long, article string, source_ids array<int>")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = grounding.verified(claims, sources, embed=embed).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(rows) == 80
    assert all(r["supported"] == (r["draft_id"] != 7) and r["similarity"] == (0.0 if r["draft_id"] == 7 else 1.0) for r in rows)


def test_sentences_in_python_and_columns(spark):
    texts = odd_texts(400)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.sentences(F.col("t")).alias("s"), T.opening_sentences(F.col("t"), 3, 20).alias("o")).orderBy("k").collect()
    for r, t in zip(rows, texts, strict=True):
        assert grounding._sentences(t) == r["s"]
        assert r["o"] == r["s"][:3]


def test_terms_found_once_each_in_order(spark):
    row = spark.createDataFrame([("The Army with por",)], "t string").select(grounding.entities(F.col("t"), ("with", "army", "with", "none")).alias("e"), T.substring_terms(F.lower("t"), ("with", "army", "with")).alias("s")).first()
    assert row["e"] == ["army", "with"] and row["s"] == ["with", "army"]


def test_phrases_are_found_as_in_squeezed_texts(spark):
    terms = ("of the", "a", "é", "bc the", "of-the", ". of", "the .", "1", "a  b", " of", "_ of", "日本 a", "the_")
    texts = [t for t in odd_texts(600) if t] + [f"{x} {y}{z}" for x in ("of", "of\t", "a-of", "xof") for y in ("the", "  the", "-the", "thes") for z in ("", "\n", ".x")]
    import re

    low = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.lower("t").alias("t"))
    rows = low.withColumns({"s": T.squeezed(F.col("t")), "w": T.tokens(F.col("t")), "v": T.tokens(F.col("t"), T.words_of(terms))})
    edge = r"[\p{L}\p{N}_]"
    old = [F.col("s").rlike((rf"(^|[^{edge[1:]})" if re.match(r"\w", t) else "") + re.sub(r"([.])", r"\\\1", t) + (rf"($|[^{edge[1:]})" if re.search(r"\w$", t) else "")) for t in terms]
    new = [[T.bounded(F.col("t"), F.col(w), t) for t in terms] for w in ("w", "v")]
    found = rows.select("k", F.array(*old).alias("old"), F.array(*new[0]).alias("all"), F.array(*new[1]).alias("known")).collect()
    for r in found:
        assert r["old"] == r["all"] == r["known"], (texts[r["k"]], r)
    assert all(any(r["old"][k] for r in found) for k in (0, 1, 2, 7))


def test_classes_do_not_squeeze_texts(spark):
    """The relevance of a text is told without its white space being squeezed, and is the same for any white space."""
    from inkstone.functions.lexicons import FIXTURE
    from inkstone.operators import classify

    body = "of the army with und von, the this of \n the thnd"
    rows = spark.createDataFrame([(1, "Of  the", body), (2, "Of the", " ".join(body.split()))], "id long, title string, content string")
    out = classify.relevance(rows, FIXTURE).select("region_score", "theme_max", "relevance_score", "category")
    a, b = out.collect()
    assert a == b and a["region_score"] > 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def counted(monkeypatch, spark):
    """An accumulator of the texts that catalog queries embed."""
    seen, plain = spark.sparkContext.accumulator(0), vector.letter_vectors

    def embed(texts):
        seen.add(len(texts))
        return plain(texts)

    monkeypatch.setattr(vector, "letter_vectors", embed)
    return seen


def test_sources_are_embedded_until_their_claims_are_supported(spark):
    tail = " ".join(f"Zz {'q' * 40}." for _ in range(60))
    told = {
        1: "Rebels crossed the river. They were seen near the bridge. " + tail,  # both claims stand in the opening
        2: tail + " Rebels crossed the river. They were seen near the bridge.",  # at the end only
        3: tail,  # nowhere
        4: "Rebels crossed the river. " + tail,  # the claim that the opening lacks has a wrong number
        5: "",
        6: "x" * (grounding.OPENING - 4) + ". Rebels crossed the river. They were seen near the bridge.",  # cut in the middle
    }
    made = [(k, "Rebels crossed the river. They were seen near the bridge. [Source 1]" if k != 4 else "Rebels crossed the river. 4711 jjjjj. [Source 1]", [1]) for k in [*told, 7]]
    made = spark.createDataFrame(made, "draft_id long, article string, source_ids array<int>")
    sources = spark.createDataFrame([(k, 1, t) for k, t in told.items()], "draft_id long, source_id int, content string")
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return vector.letter_vectors(texts)

    whole = sorted(map(tuple, grounding.verified(grounding.claims(made), sources, embed=embed).drop("similarity").collect()))
    every, seen.value = seen.value, 0
    short = grounding.verified(grounding.claims(made), sources, embed=embed, similarity=False)
    assert sorted(map(tuple, short.collect())) == whole and "similarity" not in short.columns
    assert {r["draft_id"] for r in short.filter("supported").collect()} == {1, 2, 4, 6}
    one = {k: seen_by(spark, made, sources, k) for k in (1, 4)}
    assert every > 200 and all(n < 40 for n in one.values()), one


def seen_by(spark, made, sources, draft):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return vector.letter_vectors(texts)

    grounding.verified(grounding.claims(made.filter(F.col("draft_id") == draft)), sources, embed=embed, similarity=False).collect()
    return seen.value


def test_facts_are_looked_for_only_where_claims_state_some(spark):
    asked = [(1, True, False, False), (2, False, True, False), (3, False, False, True), (4, False, False, False)]
    rows = spark.createDataFrame([(*r, "The army saw 12 km on 2024-03-05.") for r in asked], "k int, has_numbers boolean, has_dates boolean, has_entities boolean, content string")
    found = {r["k"]: (bool(r["known"]["numbers"]["whole"]), r["known"]["dates"]["whole"], r["known"]["entities"]) for r in grounding.with_facts(rows).collect()}
    assert found == {1: (True, [], []), 2: (False, ["2024-03-05"], []), 3: (False, [], ["army"]), 4: (False, [], [])}


def test_editorial_records_embed_few_texts(spark, monkeypatch):
    embeds_few(spark, monkeypatch, "editorial_records")


def test_draft_verdicts_embed_few_texts(spark, monkeypatch):
    embeds_few(spark, monkeypatch, "draft_verdicts")


def embeds_few(spark, monkeypatch, name):
    from inkstone.plans import catalog

    seen = counted(monkeypatch, spark)
    catalog.QUERIES["claim_grounding"](spark, "/root/testdata/sf0.001").collect()
    every, seen.value = seen.value, 0
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert 0 < seen.value < every / 2


def test_answers_are_parsed_once(spark, monkeypatch):
    from inkstone.plans import catalog

    seen, plain = spark.sparkContext.accumulator(0), grounding.parsed_drafts

    def parsed(answers):
        @F.udf("string")
        def told(x):
            seen.add(1)
            return x

        return plain(answers.withColumn("answer", told("answer")))

    monkeypatch.setattr(grounding, "parsed_drafts", parsed)
    n = len(catalog.QUERIES["draft_status"](spark, "/root/testdata/sf0.001").collect())
    assert seen.value == n > 0


def test_later_rounds_read_the_sources_of_open_drafts_only(spark, monkeypatch):
    told = "The river rose by 4 metres in May. Two villages were moved to the hills."
    sources = spark.createDataFrame([(k, 1, told) for k in range(6)], "draft_id long, source_id int, content string")
    requests, read, plain = spark.createDataFrame([(k,) for k in range(6)], "draft_id long"), [], grounding.verified

    def write(rows):
        text = F.when((F.col("draft_id") > 1) | (F.col("correction") != ""), "Two villages were moved to the hills. [Source 1]").otherwise("It cost 99 euros there. [Source 1]")
        return rows.select("draft_id", F.to_json(F.struct(F.lit("H").alias("headline"), text.alias("article"), F.array(F.lit(1)).alias("source_ids"))).alias("answer"))

    def verified(claims, given, **options):
        read.append(given.count())
        return plain(claims, given, **options)

    monkeypatch.setattr(grounding, "verified", verified)
    _, results = grounding.generation_rounds(requests, sources, write, terms=())
    assert {(r["draft_id"], r["attempt"], r["status"]) for r in results.collect()} == {(k, 2 if k < 2 else 1, "success") for k in range(6)}
    assert read == [6, 2]


def test_fences_of_answers():
    import re

    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice(["```", "`", "json", "JSON", " ", "\n", '{"a": "b\nc"}', "{", "}", "x", '"', "\u2003"]) for _ in range(rng.randrange(7)))
        body = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip(), flags=re.IGNORECASE)
        assert grounding.unfenced(text) == body
