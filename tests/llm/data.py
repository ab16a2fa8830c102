"""Small tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

LONG = "Thnd oner " * 30_000
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
TEXTS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "One two three."), (4, "One two three."), (4, "One two three."), (5, LONG), (None, "no id here"), (None, None),
    (6, f"Before it {PASSAGE} after it. Mail Hein.19@mail5.example.com or call +1 (743) 555-3824."), (7, "idiot " + "the of and " * 40), (8, "été Σίσυφος İstanbul 中文 👍 the"), (9, "idiot moron the end"),
]


def tables(spark, path, empty: bool = False) -> str:
    """documents with nulls, repeated rows, very long texts and clashing columns; labels, benchmark and pages to match."""
    rows = [] if empty else [(i, t, None if i == 3 else "en", None if i == 1 else "src0", None if t is None else len(t), "x", 1) for i, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, id int"
    spark.createDataFrame(rows, schema).withColumns({"fail_bits": F.lit(7), "_text": F.lit("t"), "shard": F.lit(3), "score": F.lit(0.5)}).write.parquet(f"{path}/documents.parquet")
    labels = [] if empty else [(i, 1, int(i in (7, 9))) for i in range(3, 10)] + [(7, None, None), (None, 1, 1), (3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [] if empty else [(1, PASSAGE), (2, "one two three"), (None, "zzz yyy xxx"), (3, None), (4, ""), (5, PASSAGE)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [] if empty else [(1, "http://www.A.example.com/x/?utm_source=1", "<p>a"), (2, "https://a.example.com/x", "<p>b"), (2, "https://a.example.com/x", "<p>b"), (3, None, "<p>c"), (4, "", None), (5, "no url", "z"), (None, "https://b.example.com/", "q")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("canonical_url", F.lit("clash")).write.parquet(f"{path}/pages.parquet")
    nan = float("nan")
    vectors = [] if empty else [(0, [1.0, -1.0, 0.5]), (1, None), (2, [1.0, None, 0.0]), (3, [nan, 0.0, 0.0]), (50, [0.5, 0.25, 0.125]), (50, [0.5, 0.25, 0.125]), (4, []), (None, [1.0, 1.0, 1.0]), (5, [0.001]), (6, [float("inf")] * 3), (-50, [9e3, 9e3, -9e3])]
    spark.createDataFrame([(i, v, None if i == 4 else 1) for i, v in vectors], "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "code": F.lit(2), "_key": F.lit(3)}).write.parquet(f"{path}/embeddings.parquet")
    said = [] if empty else [(0, 0, "user", "a b"), (0, 1, None, None), (0, None, "system", LONG), (3, 0, "user", "a b"), (3, 0, "user", "a b"), (None, 0, "user", "lost"), (None, None, None, None), (20, 5, "user", ""), (21, 0, "user", "x"), (-5, 1, "user", "y")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "key": F.lit(1), "depth": F.lit(2), "place": F.lit(3)}).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def python_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
