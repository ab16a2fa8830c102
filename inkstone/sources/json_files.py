"""Editorial records as JSON: one document with counts, or a line per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most records of one document; larger sets go as lines, which any number of tasks write and read.
MOST_RECORDS = 10_000


def read_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Records of whole JSON files: a list, or an object's list "articles" (none if absent); anything else there is an error.

    fields is the schema of a record, such as "id long, title string"."""
    value = F.trim(F.col("value"))
    inside = F.from_json(value, f"struct<articles: array<struct<{fields}>>>")["articles"]
    known = F.get_json_object(value, "$.articles")
    wrong = F.raise_error(F.lit("articles must be a list")).cast(f"array<struct<{fields}>>")
    listed = F.when(known.isNull(), F.array().cast(f"array<struct<{fields}>>")).when(known.startswith("["), inside).otherwise(wrong)
    rows = F.when(value.startswith("["), F.from_json(value, f"array<struct<{fields}>>")).otherwise(listed)
    return spark.read.text(path, wholetext=True).select(F.explode(rows).alias("r")).select("r.*")


def document(records: DataFrame, project: str, start: str, end: str, order: str = "article_id") -> DataFrame:
    """One row, value: the JSON document of records (with status) in this order, after its counts; at most MOST_RECORDS."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*records.columns).alias("r"))), lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0))
    is_ = lambda s: F.count_if(F.col("status") == s)
    found = records.limit(MOST_RECORDS + 1).agg(F.count(F.lit(1)).alias("n"), is_("approved").alias("approved"), is_("failed").alias("failed"), F.transform(rows, lambda x: x["r"]).alias("articles"))
    whole = F.struct(
        F.lit(project).alias("project"), F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")).alias("date_range"), F.col("n").alias("total_articles"),
        F.col("approved").alias("approved_articles"), F.col("failed").alias("failed_articles"), "articles",
    )
    return found.select(F.when(F.col("n") <= MOST_RECORDS, F.to_json(whole)).otherwise(F.raise_error(F.lit("too many records for one document"))).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    document.write.text(path)


def write_lines(records: DataFrame, path: str) -> None:
    records.write.json(path)


def read_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return spark.read.schema(fields).json(path)
