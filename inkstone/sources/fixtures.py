"""The fixture tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.session import ship, spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: title is the first line, one URL in ten repeats, dates run over fifty days."""
    d, i = spread(table(spark, sf_dir, "documents"), "doc_id"), F.col("doc_id")
    return d.select(
        i.alias("id"), F.substring(F.split("text", "\n", 2)[0], 1, 120).alias("title"), F.concat(F.lit("https://example.com/a/"), F.when(i % 10 == 9, i - 9).otherwise(i).cast("string")).alias("url"),
        "source", F.lit(None).cast("string").alias("author"), (F.lit("2026-08-25 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(i % 50)).cast("timestamp_ntz").alias("published_date"),
        F.col("text").alias("content"),
    )


ARTICLES_SQL = """articles as (select doc_id as id, substr(string_split(text, chr(10))[1], 1, 120) as title,
  'https://example.com/a/' || (case when doc_id % 10 = 9 then doc_id - 9 else doc_id end)::varchar as url, source, null::varchar as author,
  timestamp '2026-08-25 12:00:00' + to_days((doc_id % 50)::int) as published_date, text as content from documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as scored images of fifty articles, with a 64-bit hash."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        (F.col("vec_id") % 50).alias("article_id"), F.col("vec_id").alias("image_id"), F.abs(F.col("embedding")[0].cast("double")).alias("score"), (F.col("vec_id") * 1_000_003 % 4_294_967_291).alias("hash")
    )


def drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(draft_id, article, source_ids) of every document with three sentences or more, and its sources: itself and the next document.

    The second paragraph of every third draft is somebody else's text, one in five has a wrong number, one in seven cites nothing."""
    from inkstone.functions import text as T

    d = articles(spark, sf_dir).select("id", "title", "content", T.opening_sentences(F.col("content"), 3).alias("s"))
    # stored, so that the sentences are found once and not for every use of them
    d = stored(d, "drafted", "zstd").filter(F.size("s") == 3)
    i = F.col("id")
    cite = F.when(i % 7 == 0, "").otherwise(" [Source 1]")
    first = F.concat(F.col("s")[0], F.lit(" "), F.col("s")[1], F.when(i % 5 == 0, " 4711 km.").otherwise(""), cite)
    second = F.concat(F.when(i % 3 == 0, "Nothing of this kind was ever written in any of the sources.").otherwise(F.col("s")[2]), F.when(i % 4 == 0, " [source 2]").otherwise(cite))
    ids = F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    made = d.select(i.alias("draft_id"), F.concat(first, F.lit("\n"), second).alias("article"), ids.alias("source_ids"))
    own = d.select(i.alias("draft_id"), F.lit(1).alias("source_id"), "title", "content")
    return made, own.unionAll(d.select((i + 1).alias("draft_id"), F.lit(2), "title", "content"))
