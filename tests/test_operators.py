"""Operators on small hand-made rows: thresholds, ties, nulls, empty strings, accents."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import urls as U
from inkstone.functions.lexicons import DEVELOPMENT, NOT_RELEVANT, REGIONAL, SECURITY, SPORTS, STOPWORDS, Lexicons
from inkstone.operators import analytics, classify, compose, dedup, grounding, ingest, score, vector
from inkstone.operators.graph import components
from inkstone.operators.ordering import numbered


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("A  B\n\tC ", "a b c"), (None, ""), ("Été", "été")],
)
def test_normalized(spark, text, want):
    assert one(spark, T.normalized, text) == want


def test_text_functions(spark):
    assert one(spark, T.normalized_words, "Café “x”-y!") == "café x y"
    assert one(spark, T.normalized_hyphens, "Counter-Insurgency ") == "counter insurgency"
    assert one(spark, T.page_text, "a\r\nb\r\r\r\rc \t d ") == "a\nb\n\nc d"
    assert one(spark, T.sentences, "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.numbers, "50% of 3.5 km and 12 Crore") == ["50", "3.5 km", "12 crore"]
    assert one(spark, T.dates, "30 September 2026, September 30, 2026; 2026-09-30 and 03/04/2025 in 1999") == ["1999", "2025-04-03", "2026-09-30"]
    assert one(spark, T.citations, "x [Source 3] [source 1] [SOURCE 3]") == [1, 3]
    assert one(spark, T.cleaned_query, "Write an article about the India-Myanmar border, using only retrieved evidence.") == "the India-Myanmar border"
    assert one(spark, T.cleaned_query, "  ") is None
    assert one(spark, lambda c: T.query_variants(c, STOPWORDS), "The India-Myanmar fence costs money now")[-1] == "the myanmar border fence costs money now"
    assert one(spark, lambda c: T.keywords(c, STOPWORDS), "The well-known cat and the cat of it") == ["well-known", "cat", "cat"]


def test_terms_stand_between_word_boundaries(spark):
    rows = spark.createDataFrame([("café caf x",), ("cafés north-eastern army",), ("narmy",)], "t string").withColumn("w", T.tokens(F.col("t")))
    found = [r["m"] for r in rows.select(T.matched_terms(F.col("t"), F.col("w"), ["army", "caf", "north-eastern", "eastern"]).alias("m")).collect()]
    assert found == [["caf"], ["army", "north-eastern", "eastern"], []]


ROWS = [
    (1, "Indian army on alert in Assam", "army border militants assam rifles security forces", "The Assam Tribune"),
    (2, "Marathon in Guwahati draws runners", "marathon sports athletes guwahati assam medal", "x"),
    (3, "Nothing to see", "nothing at all", None),
    (4, "Railway funding for Manipur", "railway infrastructure development funding manipur imphal", ""),
    (5, "Best sunscreen of Assam", "sunscreen fertility assam development infrastructure investment", "x"),
    (6, None, None, None),
]


def articles(spark):
    day = dt.datetime(2026, 9, 20)
    return spark.createDataFrame([(i, t, c, s, day) for i, t, c, s in ROWS], "id long, title string, content string, source string, published_date timestamp_ntz")


def test_classification_with_the_default_lexicons(spark):
    rows = {r["id"]: r for r in classify.editorial(articles(spark), Lexicons()).collect()}
    assert [rows[i]["category"] for i in (1, 2, 4)] == [SECURITY, SPORTS, DEVELOPMENT]
    assert rows[3]["category"] == NOT_RELEVANT and rows[3]["relevance_score"] == 0 and rows[6]["editorial_category"] == NOT_RELEVANT
    assert rows[5]["editorial_category"] == NOT_RELEVANT and rows[5]["relevance_score"] > 0
    counts = {r["category"]: r["n"] for r in classify.category_counts(classify.editorial(articles(spark), Lexicons()), "editorial_category").collect()}
    assert counts[REGIONAL] == 0 and sum(counts.values()) == 6


@pytest.mark.parametrize(
    ("day", "want"),
    [(None, 0.0), ("2026-08-31 23:59:59", 0.0), ("2026-09-01 00:00:00", 0.0), ("2026-10-05 00:00:00", 100.0), ("2026-10-05 00:01:00", 100.0), ("2026-10-03 12:00:00", 100 - 100 / 34)],
)
def test_freshness_counts_whole_days(spark, day, want):
    got = spark.createDataFrame([(day,)], "d string").select(score.freshness(F.col("d").cast("timestamp_ntz")).alias("f")).first()["f"]
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize(("n", "title", "lines", "want"), [(299, 30, 1, 0), (300, 14, 1, 10), (300, 15, 1, 20), (799, 30, 2, 30), (800, 30, 3, 50), (1500, 30, 5, 65), (3000, 30, 8, 80), (2999, 29, 7, 55)])
def test_content_quality_steps(spark, n, title, lines, want):
    text = "\n".join(["a"] * lines)
    text += "b" * (n - len(text))
    got = spark.createDataFrame([("t" * title, text)], "t string, c string").select(score.content_quality(F.col("t"), F.col("c")).alias("q")).first()["q"]
    assert got == want


def test_rank_breaks_ties_by_date_then_id(spark):
    rows = [(1, 5, 50.0, dt.datetime(2026, 9, 1)), (2, 5, 50.0, dt.datetime(2026, 9, 2)), (3, 5, 50.0, None), (4, 0, 90.0, None), (5, 5, 0.0, None), (6, 5, 50.0, dt.datetime(2026, 9, 2))]
    df = spark.createDataFrame(rows, "id long, relevance_score int, article_score double, published_date timestamp_ntz")
    assert {r["id"]: r["rank"] for r in score.ranked(df).collect()} == {2: 1, 6: 2, 1: 3, 3: 4, 4: None, 5: None}


def test_numbering_is_global(spark):
    rng = random.Random(1)
    values = [rng.randrange(1000) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    got = {r["id"]: r["n"] for r in numbered(df, [F.col("v").desc(), F.col("id").asc()], "n").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(3000), key=lambda i: (-values[i], i)))}


def test_validation_and_funnel(spark):
    day = dt.datetime(2026, 9, 20)
    rows = [(1, "t", "u1", "s", day, "x" * 300), (2, "", "u2", None, None, "x" * 299), (3, "t", "u1", "s", day, "x" * 300), (4, "t", "old", "s", day, "x" * 300), (5, "t", "u5", "s", dt.datetime(2026, 10, 5, 0, 1), "x" * 300)]
    df = spark.createDataFrame(rows, "id long, title string, url string, source string, published_date timestamp_ntz, content string")
    errors = {r["id"]: r["e"] for r in df.select("id", ingest.validation_errors().alias("e")).collect()}
    assert errors[1] == [] and errors[2] == ["missing title", "missing source", "missing published_date", "content too short"]
    known = spark.createDataFrame([("old",)], "url string")
    assert {r["gate"]: r["n"] for r in ingest.funnel(df, known).collect()} == {"saved": 1, "duplicate": 2, "invalid": 1, "outside_date_range": 1}
    assert {r["id"] for r in ingest.new_rows(df, known).collect()} == {1, 2, 5}


def test_html_and_links(spark):
    html = '<h1>A <b>title</b></h1><article><p>One.<p> <p>Two <script>var x="</p>"</script>more</p><img src="" data-src="/i.jpg"></article><p>out</p><a href="/a/b?x=1">l</a><a href="/tag/x/y">t</a><a href="https://o.org/a/b">o</a>'
    page = ingest.parsed_page(html)
    assert page.title == "A title" and page.inside[0] == "One." and page.all[-1] == "out" and page.images == ["/i.jpg"]
    df = spark.createDataFrame([(1, "https://h.org/x/", html), (2, "https://h.org/", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in ingest.discovered(df).collect()] == [(1, "https://h.org/a/b")]
    assert {r["page_id"]: r["found"] for r in ingest.extracted(df).collect()} == {1: True, 2: False}


def test_urls(spark):
    assert one(spark, U.image_identity, "//CDN.x.org/A/Photo.JPG?w=3&v=1#f") == "cdn.x.org/a/photo?v=1"
    assert [one(spark, U.is_image, u) for u in ("https://x.org/a/site-logo.png", "https://x.org/uploads/1", "https://x.org/a.gif", "https://pinterest.com/a.jpg", "https://x.org/a.jpg")] == [False, True, False, False, True]
    assert [one(spark, U.source_priority, f"https://www.{d}/a") for d in ("thehindu.com", "nenow.in", "x.org", "canva.com")] == [3, 2, 1, 0]
    assert one(spark, U.asset_path, "data/img/a.jpg") == "../img/a.jpg"


def test_upsert_delete_and_migration(spark):
    old, new = (spark.createDataFrame(rows, "id long, v string, seq int") for rows in ([(1, "a", 0), (2, "b", 0)], [(2, "c", 1), (2, "d", 2)]))
    assert {r["id"]: r["v"] for r in ingest.upserted(old, new).collect()} == {1: "a", 2: "d"}
    assert set(ingest.ADDED) <= set(ingest.migrated(old).columns)
    titles = spark.createDataFrame([("Test Article",), (None,), ("x",)], "title string")
    assert ingest.without_title(titles).count() == 2


def brute_dedup(rows, title, content):
    """The sequential rule with difflib called directly."""
    unique, out = [], []
    for r in rows:
        hit = None
        for kind, test in (("url", lambda u: u["url"] == r["url"]), ("title", lambda u: dedup.ratio(r["t"], u["t"]) >= title), ("content", lambda u: dedup.ratio(r["c"], u["c"], 5000) >= content)):
            hit = next(((k, kind) for k, u in enumerate(unique) if test(u)), None)
            if hit:
                break
        if hit is None:
            unique.append(r)
            continue
        k, kind = hit
        u = unique[k]
        better = r["score"] > u["score"] or r["score"] == u["score"] and r["n"] >= u["n"]
        unique[k] = r if better else u
        lost, kept = (u, r) if better else (r, u)
        out.append((lost["id"], kept["id"], kind))
    return out


def test_fuzzy_dedup_equals_the_sequential_rule(spark):
    rng = random.Random(8)
    words = ["stone", "river", "table", "paper", "window", "garden", "letter", "candle", "bridge", "forest"]
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)
            body, name = base["content"].split(), base["title"].split()
            body[rng.randrange(len(body))] = "changed"
            title = " ".join(name if rng.random() < 0.5 else [rng.choice(words) for _ in range(7)])
            rows.append({"id": i, "url": base["url"] if rng.random() < 0.2 else f"u{i}", "title": title, "content": " ".join(body), "score": rng.randrange(4)})
        else:
            rows.append({"id": i, "url": f"u{i}", "title": " ".join(rng.choice(words) for _ in range(7)), "content": " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(60)), "score": rng.randrange(4)})
    df = spark.createDataFrame([(r["id"], r["url"], r["title"], r["content"], r["score"]) for r in rows], "id long, url string, title string, content string, score int")
    told = sorted(({**r, "t": r["title"], "c": r["content"], "n": len(r["content"])} for r in rows), key=lambda r: (-r["score"], r["id"]))
    want = sorted(brute_dedup(told, 0.85, 0.90))
    got = sorted((r["id"], r["matched_id"], r["reason"]) for r in dedup.deduplicated(df).collect())
    assert got == want and len({k for _, _, k in want}) == 3


def test_ratio_keeps_argument_order_and_bounds():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40))) for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b).ratio() if a != b else 1.0
        assert dedup.ratio(a, b) == want and dedup.ratio(a, b, None, 0.8) == (want if want >= 0.8 else pytest.approx(dedup.ratio(a, b, None, 0.8)))
        assert (dedup.ratio(a, b, None, 0.8) >= 0.8) == (want >= 0.8)
    assert dedup.ratio("", "x") == 0.0 and dedup.ratio(None, None) == 0.0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: find(x) for x in up}


def test_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.5}
    for tile in (8192, 20):
        assert {(r["a"], r["b"]) for r in vector.similar_pairs(df, 0.5, tile).collect()} == want
    best = {(r["query_id"], r["place"]): r["id"] for r in vector.top_k(df.filter("id < 5"), df, 3, own=False).collect()}
    for q in range(5):
        order = sorted((i for i, _ in rows if i != q), key=lambda i: -cos(rows[q][1], rows[i][1]))
        assert [best[q, k] for k in (1, 2, 3)] == order[:3]


def test_lexical_fallback(spark):
    rows = [(1, 10, "railway funding nagaon", "Railway work in Nagaon", None, "x"), (1, 11, "railway funding nagaon", "Coffee growers", "Development", "x")]
    df = spark.createDataFrame(rows, "query_id long, id long, query string, title string, category string, source string")
    assert [r["id"] for r in vector.lexical_fallback(df).collect()] == [10]


def test_grounding(spark):
    text = "The dam holds 40 million litres. It opened on 5 March 2024 in Assam."
    drafts = [
        (1, "The dam holds 40 million litres. [Source 1]\nIt opened on March 5, 2024 in Assam.", [1]), (2, "The dam holds 41 million litres. [Source 1]", [1]),
        (3, "Seven words stand in this very line\nThe dam holds 40 million litres and eight more", [1, 2]), (4, "The dam holds 40 million litres. [Source 3]", [1]), (5, "", [1]),
    ]
    made = spark.createDataFrame(drafts, "draft_id long, article string, source_ids array<int>")
    sources = spark.createDataFrame([(i, 1, "t", text) for i in range(1, 6)], "draft_id long, source_id int, title string, content string")
    claims = grounding.claims(made)
    assert {r["draft_id"]: r["n"] for r in claims.groupBy("draft_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 1, 3: 1, 4: 1}
    rows = grounding.verified(claims, sources)
    found = {(r["draft_id"], r["paragraph"]): r for r in rows.collect()}
    assert found[1, 0]["supported"] and found[1, 1]["supported"]
    assert found[2, 0]["errors"] == ["number: 41 million"] and found[3, 1]["errors"] == ["no citation"] and found[4, 0]["errors"] == ["source not available"]
    verdicts = {r["draft_id"]: r["grounded"] for r in grounding.draft_verdicts(made, rows).collect()}
    assert verdicts == {1: True, 2: False, 3: False, 4: False, 5: False}


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('```json\n{"headline": "h", "article": "a\nb", "source_ids": [1]}\n```', None), ("no", "invalid_json"), ('{"headline": "h", "article": "a", "source_ids": [true]}', "bad source_ids"),
        ('{"headline": " ", "article": "a", "source_ids": []}', "bad headline"), ('x {"article": "a", "source_ids": []} y', "missing headline"),
    ],
)
def test_drafts(answer, want):
    assert grounding.structure_error(grounding.repaired_json(answer)) == want


def test_last_attempts(spark):
    rows = [(1, 1, "grounding_failed"), (1, 2, "success"), (2, 1, "invalid_json"), (2, 2, "success"), (3, 1, "success")]
    out = {r["draft_id"]: (r["attempt"], r["status"]) for r in grounding.last_attempts(spark.createDataFrame(rows, "draft_id long, attempt int, status string")).collect()}
    assert out == {1: (2, "success"), 2: (1, "invalid_json"), 3: (1, "success")}


def words(n):
    return " ".join(["w"] * n)


def test_chunks_and_layout(spark):
    sizes = lambda body, image: [len(c.split()) for c in compose.chunks_of(body, image)]
    assert sizes(words(400), False) == [390, 10] and sizes(None, True) == []
    assert sizes(f"{words(210)}\n{words(5)}", True) == [210, 5] and sizes(f"{words(211)}\n{words(5)}", True) == [210, 6]
    assert sizes(f"{words(281)}\n{words(389)}\n{words(2)}", False) == [280, 390, 2]
    df = spark.createDataFrame([(1050, False), (1049, True), (650, False), (649, False)], "n int, i boolean")
    assert [r["l"] for r in df.select(compose.layout(F.col("n"), F.col("i")).alias("l")).collect()] == ["feature_long", "feature_image", "feature_medium", "standard"]


def test_page_plan_is_filled_or_cut(spark):
    arts = spark.createDataFrame([(1, SECURITY, 1), (2, "Other", 2)], "id long, category string, position int")
    parts = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id long, part int")
    plan = compose.page_plan(arts, parts).orderBy("page_number").collect()
    assert len(plan) == 50 and [p["kind"] for p in plan[-4:]] == list(compose.BACK) and plan[3]["kind"] == "section" and plan[4]["id"] == 1
    assert compose.plan_check(compose.page_plan(arts, parts)).first()["valid"]
    assert compose.page_plan(arts, parts, 5).count() == 5


def test_statistics_of_nothing(spark):
    none = articles(spark).filter("false").withColumns({"article_score": F.lit(1.0), "relevance_score": F.lit(1), "theme_max": F.lit(1)})
    row = analytics.overall(none).first()
    assert row["total"] == 0 and row["avg_article_score"] == 0.0 and row["first_date"] is None
    assert analytics.shares(none, "source").count() == 0


def test_images(spark):
    rows = [(1, i, h) for i, h in enumerate((0, 0b111, 0b1111111, -1))]
    out = {r["image_id"]: (r["kept_id"], r["distance"]) for r in dedup.image_duplicates(spark.createDataFrame(rows, "article_id long, image_id long, hash long")).collect()}
    assert out == {0: (None, 64), 1: (0, 3), 2: (None, 7), 3: (None, 57)}
    payload = [(1, 1, "a", "image/png", b"x", 300, 200), (1, 2, "a", "image/png", b"x", 300, 200), (1, 3, "b", "image/gif", b"x", 300, 200), (1, 4, "c", "image/jpeg; q", b"y", 299, 200), (1, 5, "d", "image/webp", b"z", 400, 400)]
    df = spark.createDataFrame(payload, "article_id long, position int, image_url string, mime string, payload binary, width int, height int")
    assert [r["image_url"] for r in ingest.accepted_images(df, 5).orderBy("position").collect()] == ["a", "d"]


def test_incremental_ingest(spark, tmp_path):
    from inkstone.streaming.ingest import new_articles

    schema = "id long, url string, published_date timestamp"
    spark.createDataFrame([(1, "a", dt.datetime(2026, 9, 1)), (2, "a", dt.datetime(2026, 9, 1))], schema).write.parquet(str(tmp_path / "in"))
    q = new_articles(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from fresh").count() == 1


def test_image_candidates(spark):
    from inkstone.operators import images as I

    html = """<meta name="twitter:image" content="/media/a.png"><script type="application/ld+json">{"x": [{"image": ["/media/b.jpg", {"url": "/media/a.webp"}]}]}</script>
      <article><img src="https://other.org/media/c.jpg"><img srcset="/media/s.jpg 1x, /media/d.jpg 2x"><img src="/icons/e.png"></article><img src="/media/out.jpg">"""
    df = spark.createDataFrame([(1, "https://h.org/x", html), (2, None, html), (3, "https://h.org/y", None)], "page_id long, url string, html string")
    own = I.candidates(df)
    assert [r["image_url"] for r in own.orderBy("place").collect()] == ["https://h.org/media/a.png", "https://h.org/media/b.jpg", "https://h.org/media/d.jpg"]
    more = spark.createDataFrame([(1, 1, "https://x.org/f.jpg"), (1, 2, "https://ndtv.com/g.jpg"), (1, 3, "https://canva.com/h.jpg")], "page_id long, place int, image_url string")
    assert [r["image_url"][-5:] for r in I.with_search_results(own, more, 4).orderBy("position").collect()] == ["a.png", "b.jpg", "d.jpg", "g.jpg"]


def test_search_phrases(spark):
    from inkstone.operators import images as I

    df = spark.createDataFrame([("Army raid in Manipur: two held", "Security"), ("The of", "x"), (None, None)], "t string, c string")
    got = [r["p"] for r in df.select(I.search_phrases(F.col("t"), F.col("c")).alias("p")).collect()]
    assert got[0] == ["manipur army raid manipur", "army raid manipur held manipur", "army raid manipur held manipur news photo", "army raid manipur held manipur security photo"] and got[1] == got[2] == []


def test_lookups_and_checks(spark):
    plan = spark.createDataFrame([(1, "article", 7), (2, "article", 8), (3, "cover", None)], "page_number int, kind string, id long")
    arts = spark.createDataFrame([(7, "a", 1), (7, "b", 2)], "id long, title string, seq int")
    assert [(r["id"], r["headline"], r["unresolved"]) for r in compose.page_lookup(plan, arts).orderBy("id").collect()] == [(7, "b", False), (8, None, True)]
    pages = spark.createDataFrame([(1, "Contents and more"), (2, None)], "page_number int, text string")
    assert {r["check"]: r["passed"] for r in compose.text_checks(pages, ("Contents", "Closing")).collect()} == {"page_text": False, "marker Contents": True, "marker Closing": False}
    told = spark.createDataFrame([(1, [1, 2])], "draft_id long, source_ids array<int>")
    known = spark.createDataFrame([(1, 1, "t")], "draft_id long, source_id int, title string")
    assert {r["source_id"]: r["missing"] for r in grounding.cited_metadata(told, known).collect()} == {1: False, 2: True}


def test_drafts_read_whole_documents(spark, tmp_path):
    from inkstone.sources.fixtures import drafts

    slow, cut = "A" * 5000 + " end. Two. Three.", "One. Two. " + "b " * 2500 + "end."
    spark.createDataFrame([(1, slow, "s"), (2, cut, "s"), (4, "One. Two.", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made, _ = drafts(spark, str(tmp_path))
    got = {r["draft_id"]: r["article"] for r in made.collect()}
    assert set(got) == {1, 2} and "end. Two." in got[1] and "Three." in got[1] and "b end." in got[2]


def test_json_files(spark, tmp_path):
    from inkstone.sources import json_files

    fields = "id long, title string, status string"
    for k, (text, want) in enumerate([('[{"id": 1, "title": "a"}, {"id": 2}]', [1, 2]), ('{"articles": [{"id": 3}], "x": 1}', [3]), ('{"x": 1}', []), ("[]", [])]):
        (tmp_path / f"{k}.json").write_text(text)
        assert [r["id"] for r in json_files.read_records(spark, str(tmp_path / f"{k}.json"), fields).collect()] == want
    (tmp_path / "bad.json").write_text('{"articles": "none"}')
    with pytest.raises(Exception, match="must be a list"):
        json_files.read_records(spark, str(tmp_path / "bad.json"), fields).collect()
    rows = spark.createDataFrame([(2, 'q"\n', "failed"), (1, "é", "approved")], fields)
    made = json_files.document(rows, "p", "2026-01-01", "2026-02-01", "id")
    json_files.write_document(made, str(tmp_path / "out"))
    assert [tuple(r) for r in json_files.read_records(spark, str(tmp_path / "out"), fields).collect()] == [(1, "é", "approved"), (2, 'q"\n', "failed")]
    json_files.write_lines(rows, str(tmp_path / "lines"))
    assert json_files.read_lines(spark, str(tmp_path / "lines"), fields).count() == 2


def test_stages_run_in_order_and_end_at_the_first_failure(spark):
    from inkstone.plans.runner import StageFailed, run_stages

    first, half = ("first", lambda s, _: s.range(10)), ("half", lambda s, rows: rows.filter("id % 2 = 0"))
    runs, made = run_stages(spark, [first, half])
    assert [(r.stage, r.status, r.rows) for r in runs] == [("first", "passed", 10), ("half", "passed", 5)] and made.count() == 5
    with pytest.raises(StageFailed) as caught:
        run_stages(spark, [first, ("bad", lambda s, rows: rows.select("nothing")), half])
    assert [(r.stage, r.status) for r in caught.value.runs] == [("first", "passed"), ("bad", "failed")]


def test_collections_of_vectors(spark):
    schema = "id long, embedding array<double>"
    assert vector.collection_info(spark.createDataFrame([], schema)).first().asDict() == {"vectors": 0, "ids": 0, "missing": 0, "least": None, "largest": None, "sound": True}
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0]), (2, None)], schema)
    assert vector.collection_info(rows).first().asDict() == {"vectors": 3, "ids": 2, "missing": 1, "least": 1, "largest": 2, "sound": False}
    with pytest.raises(Exception, match="expected 2 dimensions, found 1"):
        vector.checked(rows.filter("id = 1"), 2).collect()
    for _ in range(5):
        with pytest.raises(Exception, match="expected 2 dimensions, found none"):
            vector.checked(rows.filter("embedding is null"), 2).collect()
    with pytest.raises(Exception, match="expected 2 dimensions, found (1|none)"):
        vector.checked(rows, 2).collect()
    assert vector.checked(rows.filter("id = 1 and size(embedding) = 2"), 2).count() == 1
    assert vector.emptied(rows).columns == rows.columns and vector.emptied(rows).count() == 0


def test_counters_of_nothing(spark):
    schema = "id long, title string, url string, source string, published_date timestamp_ntz, content string"
    none = spark.createDataFrame([], schema)
    assert {r["counter"]: r["n"] for r in ingest.collection_stats(none, none, F.lit(True)).collect()} == dict.fromkeys(ingest.COUNTERS, 0)


def test_uncited_paragraphs_and_inherited_citations(spark):
    long = "These are nine words that tell something. And two sentences."
    rows = [(1, long, [1, 2]), (2, f"{long}\n[Source 1]", [1, 2]), (3, f"{long}\nMore of it. [Source 1] [Source 9]", [1, 2]), (4, "Seven words are not enough for this.", [1]), (5, None, None)]
    found = grounding.claims(spark.createDataFrame(rows, "draft_id long, article string, source_ids array<int>")).collect()
    assert sorted((r["draft_id"], r["sentence"], tuple(r["cited"])) for r in found) == [(1, 0, ()), (2, 0, (1,)), (2, 1, (1,)), (3, 0, ()), (3, 0, (1, 9))]


def test_domain_quality_and_paths(spark):
    u = F.col("u")
    rows = spark.createDataFrame([("www.THEHINDU.com",), ("news18.com",), ("mapnations.com",), ("",), (None,), ("x.org",)], "u string")
    assert [r[0] for r in rows.select(U.source_quality_score(u)).collect()] == [1.0, 0.75, 0.1, 0.3, 0.3, 0.5]
    paths = spark.createDataFrame([("/a/b/c.png",), ("/a/bc.png",), (None,)], "u string")
    assert [r[0] for r in paths.select(U.relative_path(u, "/a/b/")).collect()] == ["c.png", "/a/bc.png", None]


def test_links_as_a_parser_reads_them(spark):
    html = """<![odd[ ]><a href=/news/a-1>x</a><A title="n" HREF='/news/b&amp;c-2'>y</A><!-- <a href="/news/d-3"> --><script>'<a href="/news/e-4">'</script><a href=" "><a name=f><a href="//h.org/news/g-5#x">"""
    df = spark.createDataFrame([(1, "https://h.org/x/", html), (2, "https://h.org/", ""), (3, None, html)], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in ingest.discovered(df).collect()) == [(1, "https://h.org/news/a-1"), (1, "https://h.org/news/b&c-2"), (1, "https://h.org/news/g-5")]
    assert ingest.parsed_page("<![odd[ ]><h1>t</h1>").title == "t"


def test_structure_of_editions(spark):
    import json

    good = dict.fromkeys(compose.EDITION_KEYS, {}) | {"articles": [{"id": 1}], "page_plan": [{}, "two"]}
    pages = compose.HTML_PAGE + ' a">x</section>'
    bodies = [
        (1, json.dumps(good), pages * 2), (2, json.dumps(good), pages), (3, json.dumps({k: v for k, v in good.items() if k not in ("toc", "charts")}), pages * 2), (4, json.dumps(good | {"articles": "[1]"}), pages * 2),
        (5, json.dumps(good | {"page_plan": None}), None), (6, json.dumps(good | {"page_plan": []}), pages * 2), (7, json.dumps(good | {"articles": []}), pages * 2), (8, None, None), (9, "[]", ""),
    ]
    got = {r["edition"]: (r["problem"], r["html_pages"], r["valid"]) for r in compose.edition_checks(spark.createDataFrame(bodies, "edition int, body string, html string"), 2).collect()}
    assert got == {
        1: (None, 2, True), 2: (None, 1, False), 3: ("missing keys: charts, toc", 2, False), 4: ("articles is no list", 2, False), 5: ("page_plan is no list", 0, False),
        6: ("expected 2 pages, found 0", 2, False), 7: ("no articles", 2, False), 8: ("no JSON object", 0, False), 9: ("no JSON object", 0, False),
    }


def test_findings_in_texts(spark):
    rows = [(1, "Contents \u00a0 and\tmore", None), (2, None, None), (3, "Closing words here", "broken stream"), (4, " a  b ", None)]
    pages = spark.createDataFrame(rows, "page_number int, text string, failure string")
    found = compose.text_findings(pages, ("Contents and more", "Closing"), expected=5)
    assert {tuple(r) for r in found.collect()} == {
        ("warning", "little text", 2, "0 characters"), ("warning", "little text", 4, "3 characters"), ("error", "unreadable", 3, "broken stream"), ("error", "page count", None, "expected 5, found 4"), ("warning", "marker", None, "Closing"),
    }
    assert tuple(compose.accepted(found).first()) == (2, 3, False)
    assert tuple(compose.accepted(compose.text_findings(pages.filter("page_number = 1"), ("more",), expected=1)).first()) == (0, 0, True)
    assert {r["check"] for r in compose.text_findings(pages.limit(0), (), expected=0).collect()} == {"no readable page"}
