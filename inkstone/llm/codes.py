"""Vector code compression: product codes whose entries are found by exponion search.

Every vector is cut into equal parts; each part position has a codebook. To find a part's nearest
entry the search starts at the part's previous entry a (the first entry in the first round), whose
squared distance u to the part is computed. An entry j that is as near satisfies
|a - j| <= |a - x| + |x - j| <= 2 sqrt(u), so only the entries of a's neighbour list with
|a - j|^2 <= 4 u can win; the list is sorted by distance, so the scan ends there. All distances are
exact 64-bit integers, ties go to the lower index.

A round is one pass over the vectors, in which tasks hold the codebooks (bounded by parts, entries
and width), and one aggregation: tasks return sums per part and entry, and the new codebooks come
to the driver. Codes are stored after each round, so that the next one starts from them and a lost
executor costs a part of one round.

Defined cases: vectors that are null or hold null or non-finite components are left out; shorter
vectors end in zeros, and so do all if the length is no multiple of the number of parts; of equal
ids the lesser vector comes first into the first codebooks, null ids last; fewer rows than entries
give smaller codebooks; repeated rows count each; null labels are one label; an empty table gives
no rows. Components are at most 2^28 in size for sums to stay within 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import integer_vectors, joined_on_counted, matrix, ship, stored, widest

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose parts are searched at a time.
STRETCH = 4096


class Books:
    """Codebooks, [part, entry, component], with every entry's list of neighbours by distance and index."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)
        self.near = np.argsort(apart, axis=2, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=2)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry of x[row, part], from the entries at start; and the distances computed."""
        rows, parts = start.shape
        if not rows or not self.entries.shape[1]:
            return start, np.zeros(start.shape, np.int64), 0
        x, a = x.reshape(rows * parts, -1), start.reshape(-1)
        part = np.tile(np.arange(parts), rows)
        distance = lambda items, j: ((x[items] - self.entries[part[items], j]) ** 2).sum(1)
        items = np.arange(len(a))
        least = distance(items, a)
        reach, best, n = 4 * least, a.copy(), len(a)
        for step in range(self.entries.shape[1]):
            items = items[self.apart[part[items], a[items], step] <= reach[items]]
            if not len(items):
                break
            j = self.near[part[items], a[items], step]
            d = distance(items, j)
            n += len(items)
            better = (d < least[items]) | (d == least[items]) & (j < best[items])
            won = items[better]
            least[won], best[won] = d[better], j[better]
        return best.reshape(rows, parts), least.reshape(rows, parts), n


def first_books(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the least ids."""
    some = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    return matrix(some["v"].combine_chunks(), width).reshape(some.num_rows, parts, width // parts).transpose(1, 0, 2).copy()


def coded(rows: DataFrame, width: int, entries: np.ndarray) -> DataFrame:
    """rows (id, v, label, code, error) with the codes and errors under these codebooks; the search starts at the old codes."""
    parts = entries.shape[0]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(entries)
        for b in batches:
            v, old = matrix(b.column("v"), width), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), parts).astype(np.int64)
            found = [books.search(v[at : at + STRETCH].reshape(-1, parts, width // parts), old[at : at + STRETCH]) for at in range(0, len(b), STRETCH)]
            codes = [c.astype(np.uint8).tobytes() for got, _, _ in found for c in got]
            error = np.concatenate([e.sum(1) for _, e, _ in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("label"), pa.array(codes, pa.binary()), pa.array(error, pa.int64())], names=["id", "v", "label", "code", "error"])

    return rows.select("id", "v", "label", "code").mapInArrow(searched, rows.schema)


def centred(rows: DataFrame, width: int, entries: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are the floored means of their parts; unused entries stay."""
    parts, count, wide = entries.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * count, wide), np.int64), np.zeros(parts * count, np.int64)
        for b in batches:
            v = matrix(b.column("v"), width).reshape(-1, wide) if wide else np.zeros((len(b) * parts, 0), np.int64)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).astype(np.int64)
            cell = code + np.tile(np.arange(parts) * count, len(b))
            np.add.at(total, cell, v)
            n += np.bincount(cell, minlength=parts * count)
        used = np.flatnonzero(n)
        cell, place = np.repeat(used, wide), np.tile(np.arange(wide), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], wide))], names=["cell", "place", "total", "n"])

    sums = rows.select("v", "code").mapInArrow(summed, "cell long, place long, total long, n long")
    found = sums.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = entries.reshape(parts * count, wide).copy()
    cell, place, total, n = (found[c].to_numpy() for c in ("cell", "place", "total", "n"))
    out[cell, place] = total // n  # numpy floors
    return out.reshape(entries.shape)


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of rows (id, v, label), code a byte per part, and the final codebooks [part, entry, component]."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    width = -(-widest(rows) // parts) * parts
    rows = rows.select("id", "v", "label", F.lit(bytes(parts)).alias("code"), F.lit(0).cast("long").alias("error"))
    books = first_books(rows, width, parts, entries)
    for _ in range(rounds):
        rows = stored(coded(rows, width, books), "coded")
        books = centred(rows, width, books)
    return stored(coded(rows, width, books).select("id", "label", "code", "error"), "codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of embeddings."""
    rows = stored(integer_vectors(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label"), "whole")
    codes, books = compressed(rows)
    codes = codes.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    labels = stored(codes.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    told = joined_on_counted(codes, labels, "_key", "_n", codes.count())
    return told.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(book: str) -> str:
    return f"""
  SELECT vec_id, m, x, e, d FROM (
    SELECT p.vec_id, p.m, p.x, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
      row_number() OVER (PARTITION BY p.vec_id, p.m ORDER BY d, b.e) AS n
    FROM parts p JOIN {book} b USING (m)) WHERE n = 1"""


def _centre(assigned: str, book: str) -> str:
    return f"""
  SELECT b.m, b.e, coalesce(c.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT m, e, list(y ORDER BY k) AS x FROM (
      SELECT m, e, k, floor(sum(x[k])::DOUBLE / count(*))::BIGINT AS y FROM {assigned}, (SELECT unnest(range(1, 5)) AS k) GROUP BY m, e, k) GROUP BY m, e) c USING (m, e)"""


#: For vectors of 64 components, as the given tables have.
OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, m, v[4 * m + 1 : 4 * m + 4] AS x FROM kept, (SELECT unnest(range(16)) AS m)
), b0 AS (SELECT m, (row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1) AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), a1 AS ({_assign("b0")}), b1 AS ({_centre("a1", "b0")}
), a2 AS ({_assign("b1")}), b2 AS ({_centre("a2", "b1")}
), a3 AS ({_assign("b2")}
), codes AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY m) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id
), book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY m, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), book
"""
