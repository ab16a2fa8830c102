"""Lexicon tables, whole-set image dedup, the embedding cache, image relevance and rounds of generation."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstone.operators import dedup, grounding, lexicon, vector
from inkstone.plans import catalog
from inkstone.session import new_path, tables_stored

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("broadcast_terms", [200_000, 10])
def test_a_lexicon_of_a_hundred_thousand_terms(spark, broadcast_terms):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(4000)]
    terms = list(dict.fromkeys(rng.choice((" ", "-")).join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(110_000)))[:100_000]
    texts = [(i, " ".join(rng.choice(words) for _ in range(60)) + rng.choice(("", " c++ end", "-" + words[0], " x.y"))) for i in range(30)] + [(90, None), (91, ""), (92, "c++x c++")]
    table = spark.createDataFrame([("l", t, 1 + len(t)) for t in [*terms, "c++", "x.y", "(ab) cd"]] + [("m", terms[0], 2), ("m", terms[0], 2)], "lexicon string, term string, weight int")
    got = {(r["id"], r["lexicon"], r["term"], r["weight"]) for r in lexicon.term_hits(spark.createDataFrame(texts, "id long, text string"), table, broadcast_terms).collect()}
    want = set()
    for i, text in texts:
        for t in ["c++", "x.y", "(ab) cd"]:
            if re.search((r"(?<!\w)" if t[0].isalnum() else "") + re.escape(t) + (r"(?!\w)" if t[-1].isalnum() else ""), text or ""):
                want.add((i, "l", t, 1 + len(t)))
        pieces = re.findall(r"\w+|\W+", text or "")
        known = set(terms)
        for a in range(len(pieces)):
            for n in (1, 3, 5):
                t = "".join(pieces[a : a + n])
                if t in known and a + n <= len(pieces):
                    want |= {(i, "l", t, 1 + len(t))} | ({(i, "m", t, 2)} if t == terms[0] else set())
    assert got == want and len(want) > 500
    with pytest.raises(Exception, match="a term without a word"):
        lexicon.term_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([("l", "%", 1)], "lexicon string, term string, weight int")).collect()


def test_images_of_a_whole_set(spark):
    rng = random.Random(6)
    hashes, signed = [], lambda x: x - (1 << 64) if x >> 63 else x
    for _ in range(40):
        at = rng.getrandbits(64)
        hashes.append(at)
        for _ in range(rng.randint(0, 8)):  # chains that walk away, and copies
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                at ^= 1 << bit
            hashes.append(at)
    rng.shuffle(hashes)
    rows = [(i, signed(h)) for i, h in enumerate(hashes)] + [(9999, None)]
    kept, want = [], {9999: (None, None)}
    for i, h in enumerate(hashes):
        near = min((((h ^ k).bit_count(), j) for j, k in kept), default=(64, None))
        if near[0] <= 6:
            want[i] = (near[1], near[0])
        else:
            kept.append((i, h))
            want[i] = (None, None)
    got = {r["image_id"]: (r["kept_id"], r["distance"]) for r in dedup.distinct_images(spark.createDataFrame(rows, "image_id long, hash long")).collect()}
    assert got == want and sum(k is not None for k, _ in want.values()) > 40
    assert dedup.distinct_images(spark.createDataFrame([], "image_id long, hash long")).count() == 0


def test_a_cache_embeds_each_text_once(spark):
    path, seen = new_path(spark, "vectors"), spark.sparkContext.accumulator(0)

    def embed(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0])

    rows = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("",)], "t string")
    first, n = vector.cached_embeddings(rows, "t", path, embed)
    assert n == 3 == seen.value and first.count() == 3
    more, n = vector.cached_embeddings(rows.unionAll(spark.createDataFrame([("ccc",)], "t string")).filter("t <> 'bb'"), "t", path, embed)
    assert n == 1 and seen.value == 4 and sorted(r["embedding"][0] for r in more.collect()) == [0.0, 1.0, 3.0]


def test_a_cache_is_the_only_copy_of_its_vectors(spark, tmp_path):
    told = " ".join(f"Sentence {i} of the source has words {i * 7919}." for i in range(400))
    sources = spark.createDataFrame([(1, 1, told)], "draft_id long, source_id int, content string")
    made = spark.createDataFrame([(1, "Sentence 5 of the source has words 39595. [Source 1]", [1])], "draft_id long, article string, source_ids array<int>")
    since, path = tables_stored(spark), str(tmp_path / "cache")
    rows = grounding.verified(grounding.claims(made), sources, cache=path).collect()
    assert [(r["similarity"], r["supported"]) for r in rows] == [(1.0, True)]
    assert spark.read.parquet(path).count() == 400
    # neither the vectors nor the distinct texts are stored beside the cache
    assert [p.rsplit("/", 1)[1] for p in spark.sparkContext._inkstone_stored[since:]] == ["asked"]


def test_images_without_text_come_last(spark):
    texts = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "article_id long, embedding array<double>")
    images = spark.createDataFrame([(1, 1, [0.0, 1.0]), (1, 2, [2.0, 0.0]), (1, 3, None), (2, 4, [1.0, 1.0]), (3, 5, [1.0, 1.0])], "article_id long, image_id long, embedding array<double>")
    got = {r["image_id"]: (r["score"], r["relevant"], r["rank"], r["best"]) for r in vector.image_relevance(texts, images).collect()}
    assert got == {2: (1.0, True, 1, True), 1: (0.0, False, 2, False), 3: (None, False, 3, False), 4: (None, False, 1, False), 5: (None, False, 1, False)}


def test_rounds_of_generation(spark):
    source = "The river rose by 4 metres in May. Two villages were moved to the hills. Nobody was hurt there."
    sources = spark.createDataFrame([(i, 1, source) for i in range(1, 6)], "draft_id long, source_id int, content string")
    requests = spark.createDataFrame([(i,) for i in range(1, 7)], "draft_id long")
    seen = []

    def write(rows):
        seen.append({(r["draft_id"], r["outer"], r["attempt"], r["correction"]) for r in rows.collect()})
        good, bad = "Two villages were moved to the hills. [Source 1]", "Two villages were moved to the hills. It cost 99 million euros there. [Source 1]"
        text = (
            F.when(F.col("draft_id") == 1, good)  # at once
            .when(F.col("draft_id") == 2, F.when(F.col("correction").contains("99 million"), good).otherwise(bad))  # after a correction
            .when(F.col("draft_id") == 3, F.when(F.col("outer") == 2, good).otherwise(bad))  # in the second outer attempt
            .when(F.col("draft_id") == 4, bad)  # never
            .otherwise(good)
        )
        body = F.to_json(F.struct(F.lit("H").alias("headline"), text.alias("article"), F.array(F.lit(1)).alias("source_ids")))
        return rows.select("draft_id", F.when((F.col("draft_id") == 5) & (F.col("outer") == 1), "no json").otherwise(body).alias("answer"))

    attempts, results = grounding.generation_rounds(requests, sources, write, terms=())
    told = sorted((r["draft_id"], r["outer"], r["attempt"], r["status"]) for r in attempts.collect())
    g, ok = "grounding_failed", "success"
    assert told == [(1, 1, 1, ok), (2, 1, 1, g), (2, 1, 2, ok), (3, 1, 1, g), (3, 1, 2, g), (3, 2, 1, ok), (4, 1, 1, g), (4, 1, 2, g), (4, 2, 1, g), (4, 2, 2, g), (5, 1, 1, "invalid_json"), (5, 2, 1, ok), (6, 1, 1, "insufficient_evidence")]
    assert {r["draft_id"]: (r["outer"], r["attempt"], r["status"]) for r in results.collect()} == {1: (1, 1, ok), 2: (1, 2, ok), 3: (2, 1, ok), 4: (2, 2, g), 5: (2, 1, ok), 6: (1, 1, "insufficient_evidence")}
    corrections = {(i, o, a): c for s in seen for i, o, a, c in s}
    assert corrections[2, 1, 1] == "" and "It cost 99 million euros there." in corrections[2, 1, 2] and corrections[4, 2, 1] == "" and len(seen) == 4


def test_first_attempts_are_the_drafts_own(spark):
    found = {r["draft_id"]: r["status"] for r in catalog.queries()["generation_rounds"](spark, DIR).filter("outer = 1 and attempt = 1").collect()}
    again = catalog.queries()["generation_rounds"](spark, DIR).filter("outer > 1 or attempt > 1").count()
    assert "success" in found.values() and again > 0


def test_claims_through_the_cache(spark, tmp_path):
    told = "The river rose by 4 metres in May. Two villages were moved to the hills. Nobody was hurt there."
    sources = spark.createDataFrame([(1, 1, told), (1, 2, ""), (2, 1, told), (3, 1, None)], "draft_id long, source_id int, content string")
    text = "Two villages were moved to the hills. [Source 1]\nThe river rose by 5 metres in May. [Source 1] [Source 2]\nThis has no citation at all but has words enough. "
    made = spark.createDataFrame([(i, text, [1, 2]) for i in (1, 2, 3, 4)], "draft_id long, article string, source_ids array<int>")
    seen, path = spark.sparkContext.accumulator(0), str(tmp_path / "cache")

    def embed(texts):
        seen.add(len(texts))
        return vector.hashed_vectors(texts)

    plain = sorted(map(tuple, grounding.verified(grounding.claims(made), sources).collect()))
    for _ in range(2):
        assert sorted(map(tuple, grounding.verified(grounding.claims(made), sources, embed=embed, cache=path).collect())) == plain
    claims = {r["claim"] for r in grounding.claims(made).filter("size(cited) > 0").collect()}
    assert seen.value == len(claims | {"The river rose by 4 metres in May.", "Two villages were moved to the hills.", "Nobody was hurt there."})  # once each, nothing in the second run
    assert grounding.verified(grounding.claims(made.limit(0)), sources, cache=path).count() == 0
