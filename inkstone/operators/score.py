"""Editorial scores and the rank of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.lexicons import DEFAULT_SOURCE_SCORE, SCORE_WEIGHTS, SECURITY, Lexicons
from inkstone.operators.classify import RAW
from inkstone.operators.ordering import numbered

START, END = "2026-09-01", "2026-10-05"


def freshness(published: Column, start: str = START, end: str = END) -> Column:
    """100 at the end of the window, 0 before its start or without a date; age in whole days, floored."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    day = F.least(published.cast("timestamp_ntz"), last)
    age, total = F.floor((seconds(last) - seconds(day)) / 86400), F.floor((seconds(last) - seconds(first)) / 86400)
    return F.when(published.isNull() | (published < first), 0.0).when(total <= 0, 100.0).otherwise(100.0 - age / total * 100.0)


def source_quality(source: Column, scores: dict[str, int], default: int = DEFAULT_SOURCE_SCORE) -> Column:
    table = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    return F.when(F.coalesce(source, F.lit("")) == "", 0).otherwise(F.coalesce(F.try_element_at(table, source), F.lit(default)))


def content_quality(title: Column, content: Column) -> Column:
    title, content = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    size, lines = F.length(content), F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""))
    steps = lambda c, *pairs: F.coalesce(*[F.when(c >= least, points) for least, points in pairs], F.lit(0))
    total = steps(F.length(title), (30, 20), (15, 10)) + steps(size, (3000, 40), (1500, 30), (800, 20), (300, 10)) + steps(lines, (8, 20), (5, 15), (3, 10))
    return F.when(size < 300, 0).otherwise(total)


def security_relevance(text: Column, category: Column, terms: tuple[str, ...]) -> Column:
    hits = F.least(F.lit(100), 15 * F.size(T.substring_terms(text, terms)))
    return F.least(F.lit(100), hits + F.when(category == SECURITY, 40).otherwise(0))


def scored(rows: DataFrame, lexicons: Lexicons, start: str = START, end: str = END) -> DataFrame:
    """Classified rows with the score components and article_score (two decimals)."""
    clamp = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c.cast("double")))
    parts = {
        "region": F.col("region_score"),
        "theme": F.least(F.lit(100.0), F.greatest(*RAW) / 50 * 100),
        "security": security_relevance(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))), F.col("category"), lexicons.security_hits),
        "freshness": freshness(F.col("published_date"), start, end),
        "source": source_quality(F.col("source"), lexicons.source_scores),
        "content": content_quality(F.col("title"), F.col("content")),
    }
    rows = rows.withColumns({f"{k}_part": F.round(clamp(v), 2) for k, v in parts.items()})
    # in decimals, so that ties in the third place round alike everywhere
    total = sum((F.lit(f"{SCORE_WEIGHTS[k]:.2f}").cast("decimal(3,2)") * F.col(f"{k}_part").cast("decimal(7,2)") for k in parts), F.lit(0).cast("decimal(3,2)"))
    return rows.withColumn("article_score", F.round(F.least(total, F.lit(100).cast("decimal(5,2)")), 2).cast("double"))


def persisted(rows: DataFrame) -> DataFrame:
    """Whole-number scores as they are stored; rows that are not relevant get zeros."""
    whole = lambda c: F.when(F.col("relevant"), F.bround(c, 0).cast("int")).otherwise(0)
    return rows.withColumns({name: whole(F.col(name)) for name in ("article_score", "theme_part", "security_part", "freshness_part", "source_part", "content_part")})


def ranked(rows: DataFrame) -> DataFrame:
    """rank 1..n by article_score and date, both descending, then id; null for rows without a score."""
    able = (F.col("relevance_score") > 0) & (F.col("article_score") > 0)
    order = [F.col("article_score").desc(), F.col("published_date").desc_nulls_last(), F.col("id").asc()]
    numbers = numbered(rows.filter(able).select("id", "article_score", "published_date"), order, "rank").select("id", "rank")
    return rows.drop("rank").join(numbers, "id", "left")
