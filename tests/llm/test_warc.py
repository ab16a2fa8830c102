import random

from pyspark.sql import functions as F

from inkstone.llm import warc as W


def brute(records):
    """(record_id, source_id) by looking at all earlier records."""
    out = {}
    for r in records:
        if r[3]:
            before = [x for x in records if not x[3] and x[1] == r[1] and r[1] is not None and (x[2], x[0]) < (r[2], r[0])]
            out[r[0]] = max(before, key=lambda x: (x[2], x[0]))[0] if before else None
    return out


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(6)
    urls = ["https://a.example.com/hot"] * 6 + ["https://b.example.com/x", "https://c.example.com/y", None]
    rows = [(i, rng.choice(urls), rng.randrange(60), rng.random() < 0.6, rng.choice("pq"), {"ETag": rng.choice(["1", "W/1", "2"]), "X-Keep": str(i), "Date": str(i)}) for i in range(300)]
    df = spark.createDataFrame(rows, W.RECORD)
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["record_id"]: r for r in W.resolved(df).collect()}
        want = brute(rows)
        assert {k: r["source_id"] for k, r in got.items()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_id = {r[0]: r for r in rows}
    for k, r in got.items():
        if want[k] is not None:
            same = by_id[k][5]["ETag"].removeprefix("W/") == by_id[want[k]][5]["ETag"].removeprefix("W/")
            assert r["outcome"] == ("resolved" if same else "mismatch")
            if same:
                assert r["headers"]["x-keep"] == str(want[k]) and r["headers"]["date"] == str(k) and r["headers"]["etag"] == by_id[k][5]["ETag"]


def test_validators_and_bodies(spark):
    rows = [(1, "http://www.a.com:80/p/", 1, False, None, {"Last-Modified": "x"}), (2, "https://A.com/p#f", 2, True, None, {"last-modified": "x", "Content-Length": "0"}), (3, "https://a.com/p", 3, True, None, None), (4, None, 4, True, None, {})]
    df = spark.createDataFrame(rows, W.RECORD).withColumn("body", F.lit("B"))
    got = {r["record_id"]: r for r in W.with_bodies(W.resolved(df), df).collect()}
    assert got[2]["outcome"] == "resolved" and got[2]["body"] == "B" and "content-length" not in got[2]["headers"]
    assert got[3]["outcome"] == "no_validator" and got[3]["body"] is None and got[4]["outcome"] == "no_url"


def test_canonical_urls(spark):
    urls = {"HTTP://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#f": "example.com/a/b?a=1&b=2", "https://u:p@x.org": "x.org", "nothing": "nothing"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", W.canonical_url(F.col("u")).alias("c")).collect()} == urls
