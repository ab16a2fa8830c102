"""What several operators share: the shared folder, tables written there, null-safe keys, integer vectors, joins on hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.session import new_path, ship, stored  # noqa: F401

#: ASCII white space that separates words, as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds (null ids: fold 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def integer_vectors(rows: DataFrame, id: str, vector: str, *more: str) -> DataFrame:
    """(id, v, *more) with v = floor(256 * x) of every component; rows whose vector is null or holds a null or non-finite
    component are left out. Vectors of any length, empty ones too, are kept."""
    x = F.col(vector)
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(256 * e.cast("double")))
    return rows.filter(x.isNotNull() & ~odd).select(F.col(id).cast("long").alias("id"), whole.alias("v"), *more)


def widest(vectors: DataFrame) -> int:
    """The largest length of v; 0 for an empty table."""
    return vectors.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of longs; shorter ones end in zeros."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if len(flat) == n * width:
        return flat.reshape(n, width).astype(np.int64)
    out = np.zeros((n, width), np.int64)
    row = np.repeat(np.arange(n), np.diff(ends))
    out[row, np.arange(len(flat)) - ends[row]] = flat
    return out


#: A key that holds more than this share of the rows counts as hot: there are at most so many such keys.
HOT_KEYS = 10_000


def joined_on_counted(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left-joined with a table of unique keys, which says in n how many rows have its key; total: of rows.

    Hot keys, HOT_KEYS at most by their definition, are broadcast and their rows stay where they are; all others are shuffled.
    Both are read twice, so they should be stored. Null keys match nothing."""
    hot = table.filter(F.col(n) * HOT_KEYS > total)
    near = rows.join(F.broadcast(hot.drop(n)), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(n) * HOT_KEYS <= total).drop(n), key, "left")
    return near.unionByName(far)
