"""Statistics over classified articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.lexicons import CATEGORY_ORDER


def overall(articles: DataFrame) -> DataFrame:
    """One row: count, averages with nulls as zero, first and last date (null range for no rows)."""
    mean = lambda c: F.coalesce(F.round(F.avg(F.coalesce(c, F.lit(0))), 2), F.lit(0.0)).alias(f"avg_{c}")
    day = lambda f, n: F.date_format(f("published_date"), "yyyy-MM-dd").alias(n)
    return articles.agg(F.count(F.lit(1)).alias("total"), mean("article_score"), mean("relevance_score"), mean("theme_max"), day(F.min, "first_date"), day(F.max, "last_date"))


def shares(articles: DataFrame, column: str) -> DataFrame:
    """(name, n, percent) by count of the column's values that are not null."""
    counts = articles.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # a row per value
    return counts.select("name", "n", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 2).alias("percent"))


def daily(articles: DataFrame) -> DataFrame:
    day = F.date_format("published_date", "yyyy-MM-dd").alias("day")
    return articles.filter("published_date is not null").groupBy(day).agg(F.count(F.lit(1)).alias("n"))


def group_coverage(articles: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, n): articles that mention any of a group's words; groups without articles are left out."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    rows = articles.select(text.alias("_t")).withColumn("_w", T.tokens(F.col("_t"), T.words_of(t for ts in groups.values() for t in ts)))
    hit = F.array_compact(F.array(*[F.when(T.any_term(F.col("_t"), F.col("_w"), ts), F.lit(g)) for g, ts in groups.items()]))
    return rows.select(F.explode(hit).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


#: Names counted as mentions.
STATE_NAMES = ("Assam", "Arunachal Pradesh", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Sikkim", "Tripura")


def mentions(articles: DataFrame, names: tuple[str, ...] = STATE_NAMES) -> DataFrame:
    """(name, n): articles whose title or body has the name as a whole word."""
    return group_coverage(articles, {n: (n.lower(),) for n in names})


def source_lines(articles: DataFrame) -> DataFrame:
    """Lines like "src1: 3 article(s)", one for each source."""
    return source_rows(articles).select(F.format_string("%s: %d article(s)", "source", "n").alias("line"))


def source_rows(articles: DataFrame) -> DataFrame:
    source = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "Unknown Source").otherwise(F.trim("source"))
    return articles.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def category_lines(articles: DataFrame) -> DataFrame:
    """(place, line) like "Development: 3", in the fixed order, without zeros."""
    known = articles.sparkSession.createDataFrame(list(enumerate(CATEGORY_ORDER)), "place int, category string")
    counts = articles.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "category").select("place", F.format_string("%s: %d", "category", "n").alias("line"))


def word_totals(articles: DataFrame) -> DataFrame:
    n = T.word_count(F.col("content")).cast("long")
    return articles.agg(F.coalesce(F.sum(n), F.lit(0)).alias("words"), F.coalesce(F.bround(F.avg(n), 0).cast("long"), F.lit(0)).alias("mean_words"))


def edition(articles: DataFrame) -> DataFrame:
    day = lambda f, n: F.date_format(f("published_date"), "yyyy-MM-dd").alias(n)
    return articles.agg(day(F.min, "first_date"), day(F.max, "last_date"), F.count(F.lit(1)).alias("articles"), F.countDistinct(F.when(F.col("source") != "", F.col("source"))).alias("sources"))


def top(articles: DataFrame, limit: int = 10) -> DataFrame:
    return articles.orderBy(F.coalesce("article_score", F.lit(0)).desc(), "id").limit(limit)


def batch_summary(results: DataFrame, counts: list[str]) -> DataFrame:
    """Sums of whole-number columns over a batch, nulls as zero."""
    return results.agg(F.count(F.lit(1)).alias("articles"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def status_totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("approved"), F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("failed"))


def image_rank(images: DataFrame) -> DataFrame:
    order = Window.partitionBy("article_id").orderBy(F.col("score").desc(), "image_id")
    return images.withColumn("rank", F.row_number().over(order))


def best_image(images: DataFrame, least: float = 0.20) -> DataFrame:
    return image_rank(images.filter(F.col("score") >= least)).filter("rank = 1").drop("rank")
