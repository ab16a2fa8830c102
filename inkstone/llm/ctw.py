"""Context-tree weighting over binary-decomposed bytes, trained on and applied to whole corpora.

A text is a row of tokens: its words (A-Z lower-cased, split at ASCII white space) and one end.
It is spelt as bytes: words joined by blanks, then a line feed. Each byte is eight binary
decisions, and each decision is predicted in the context of the bytes before it, nearest first,
at most DEPTH deep (line feeds before the text's start). Every context of every depth keeps a
Krichevsky-Trofimov estimate; the tree weights them by half at each node, exactly
P = (KT + product of the children) / 2, so all depths mix. The tree is frozen after training;
``score`` is log10 of the product over a text's bytes, the probability of its row of tokens.

How it scales: nothing unbounded is broadcast or collected.
* Each task counts its distinct words and byte grams (a byte with its context), and the counts
  are summed by a shuffle.
* Grams are grouped by the three nearest context bytes; the subtrees of whole groups are weighted
  in stretches, and one group holds at most the distinct grams of three bytes. The tree's top
  (contexts of up to two bytes, 65,793 times 255 decisions at most whatever the corpus) is
  summed by a shuffle and mixed on the driver.
* The most frequent words and grams, by a count threshold that keeps them under MOST_WORDS and
  MOST_GRAMS, are broadcast. Whatever else a text has is joined with the full tables and added:
  the result is the same for every value of these bounds, up to the order of summing doubles.
  Predictions seen from depth TOP are kept in single precision, for all grams alike.

Defined cases: null text is empty (the end token only); an empty table, or one without training
rows, gives probabilities of the untrained tree (one half a decision); repeated rows count
each time; null ids count as fold 0; words of any length are spelt whole.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, fold, joined_on_counted, new_path, stored

DEPTH, FOLDS, HELD_OUT = 5, 7, 2
END = b"\n"
#: Most entries that are broadcast: 10 MB of words (longer ones by their MD5), 64 MB of grams.
MOST_WORDS, MOST_GRAMS, LONGEST_WORD = 1 << 17, 1 << 21, 64
#: Bytes of text that a task handles at a time, and distinct words that it counts before it passes them on.
BLOCK_BYTES, HELD_WORDS = 1 << 20, 1 << 20
#: Bytes of text that are looked up at a time: a gram takes some hundred bytes there, beside the broadcast tables.
LOOKED_UP_BYTES = 1 << 18
#: Context bytes that name a group of grams, and grams that are weighted at a time (whole groups).
TOP, HELD_GRAMS = 3, 1 << 16
LN2 = math.log(2)


def tokens(text: str | None) -> list[bytes]:
    return [*text.encode().lower().split(), END] if text else [END]


# ---- the tree ----


def _table(step: float, n: int) -> np.ndarray:
    """log-gamma of step, step + 1, ... by summing logarithms."""
    return math.lgamma(step) + np.concatenate([[0.0], np.cumsum(np.log(step + np.arange(n - 1)))])


_WHOLE, _HALF = _table(1.0, 4096), _table(0.5, 4096)


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    """log-gamma of n + shift for whole n and shift 1 or 1/2."""
    table = _WHOLE if shift == 1 else _HALF
    x = np.maximum(n, 1.0) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a block with these counts."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def grams_of(spelt: bytes, depth: int = DEPTH) -> np.ndarray:
    """One code per byte of spelt texts, each closed by a line feed: the depth bytes before it, then the byte.

    Contexts stop at the text's start: bytes of the text before read as line feeds."""
    raw = np.frombuffer(END * depth + spelt, np.uint8)
    n = len(spelt)
    out = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for k in range(depth + 1):
        near = raw[depth - k : depth - k + n]
        if k:
            ended |= near == 10
            near = np.where(ended, np.uint8(10), near)
        out |= near.astype(np.int64) << (8 * k)
    return out


def _node_keys(grams: np.ndarray, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, bit) of the eight decisions in the context of depth d; a key is the context and the bits so far."""
    context = (grams >> 8) & ((1 << 8 * d) - 1)
    byte = grams & 255
    return [((context << 8) | (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1) for b in range(8)]


def subtree(grams: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Prediction of each gram's eight bits as seen from depth top, and (keys, log weights, zeros, ones) of the nodes there.

    All grams that share a node at depth top must be given."""
    tables: dict[int, tuple[np.ndarray, ...]] = {}
    seen = counts > 0
    for d in range(top, depth + 1):
        pairs = _node_keys(grams[seen], d)
        keys, bits = np.concatenate([k for k, _ in pairs]), np.concatenate([b for _, b in pairs])
        unique, at = np.unique(keys, return_inverse=True)
        weight = np.tile(counts[seen], 8).astype(np.float64)
        ones = np.bincount(at, weights=weight * bits, minlength=len(unique)).astype(float)
        zeros = np.bincount(at, weights=weight * (1 - bits), minlength=len(unique)).astype(float)
        tables[d] = (unique, zeros, ones)
    stop: dict[int, np.ndarray] = {}
    for d in range(depth, top - 1, -1):
        unique, zeros, ones = tables[d]
        kt = log_kt(zeros, ones)
        if d == depth:
            log_weight, stop[d] = kt, np.ones(len(unique))
        else:
            parent = ((below >> 8) & ((1 << 8 * d) - 1)) << 8 | (below & 255)
            children = np.bincount(np.searchsorted(unique, parent), weights=log_weight, minlength=len(unique))
            log_weight = np.logaddexp(kt, children) - LN2
            stop[d] = np.exp(kt - LN2 - log_weight)
        below = unique
    predicted = np.full((len(grams), 8), 0.5)
    for d in range(depth, top - 1, -1):
        unique, zeros, ones = tables[d]
        if not len(unique):
            continue
        for b, (key, bit) in enumerate(_node_keys(grams, d)):
            at = np.minimum(np.searchsorted(unique, key), len(unique) - 1)
            kt = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            mixed = stop[d][at] * kt + (1 - stop[d][at]) * predicted[:, b]
            predicted[:, b] = np.where(unique[at] == key, mixed, 0.5)
    unique, zeros, ones = tables[top]
    return predicted, (unique, log_weight, zeros, ones)


class Top:
    """The contexts of up to two bytes: dense tables up to one byte, a sorted table for two."""

    def __init__(self, keys: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Of the nodes of depth two, keys ascending (context << 8 | bits so far), the sum of their children's log weights, and counts."""
        self.keys, self.zeros, self.ones, self.stop = {2: keys}, {2: zeros}, {2: ones}, {}
        for d in (2, 1, 0):
            kt = log_kt(self.zeros[d], self.ones[d])
            log_weight = np.logaddexp(kt, below) - LN2
            self.stop[d] = np.exp(kt - LN2 - log_weight)
            if d:
                size = 256**d
                up = (((keys >> 8) & (size // 256 - 1)) << 8) | (keys & 255) if d == 2 else np.arange(1 << 16) & 255
                log_weight = np.where(self.zeros[d] + self.ones[d] > 0, log_weight, 0.0)
                below, self.zeros[d - 1], self.ones[d - 1] = (np.bincount(up, weights=x, minlength=size) for x in (log_weight, self.zeros[d], self.ones[d]))

    def log10(self, grams: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte, from its bits' predictions seen from depth TOP."""
        total = np.zeros(len(grams))
        each = {d: _node_keys(grams, d) for d in (2, 1, 0)}
        for b in range(8):
            p = deep[:, b]
            for d in (2, 1, 0):
                key, bit = each[d][b]
                at = key
                there = np.ones(len(grams), bool)
                if d == 2:
                    at = np.minimum(np.searchsorted(self.keys[2], key), max(0, len(self.keys[2]) - 1))
                    there = self.keys[2][at] == key if len(self.keys[2]) else ~there
                    at = at if len(self.keys[2]) else None
                if at is None:
                    p = np.full(len(grams), 0.5)
                    continue
                zeros, ones = self.zeros[d][at], self.ones[d][at]
                kt = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
                p = np.where(there & (zeros + ones > 0), self.stop[d][at] * kt + (1 - self.stop[d][at]) * p, 0.5)
            total += np.log10(p)
        return total


def weighted(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, log10 probability of its byte) for every gram of (gram, n); grams with n = 0 are only predicted."""
    spark = grams.sparkSession
    if depth < TOP:
        raise ValueError(f"contexts of {TOP} bytes at least")

    def told(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        deep, (keys, logs, zeros, ones) = subtree(codes, counts, TOP, depth)
        keys = ((keys >> 8) & 0xFFFF) << 8 | (keys & 255)
        both, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(both)) for x in (logs, zeros, ones)]
        n, m = len(codes), len(both)
        raw = np.ascontiguousarray(deep, np.float32)
        bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(raw)]).cast(pa.binary())
        names = ["kind", "gram", "n", "bits", "key", "log_weight", "zeros", "ones"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(codes), pa.array(counts), bits, pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.float64())] * 3], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(both.astype(np.int64)), *map(pa.array, sums)], names=names)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
                if len(held[0]) < HELD_GRAMS:
                    continue
            if not len(held[0]):
                continue
            whole = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
            if whole:
                yield from told(held[1][:whole], held[2][:whole])
                held = [h[whole:] for h in held]

    schema = "kind int, gram long, n long, bits binary, key long, log_weight double, zeros double, ones double"
    path = new_path(spark, "tree")
    group = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)).alias("group")
    spread = grams.select(group, "gram", "n").repartition("group").sortWithinPartitions("group")
    spread.mapInArrow(trees, schema).write.partitionBy("kind").parquet(path)
    read = spark.read.schema(schema).parquet(path)
    sums = read.filter("kind = 1").groupBy("key").agg(F.sum("log_weight"), F.sum("zeros"), F.sum("ones")).toArrow()  # 65,536 * 255 rows at most
    keys, *values = (c.to_numpy() for c in sums.columns)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast(Top(keys[order].astype(np.int64), *[v[order].astype(np.float64) for v in values]))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        for b in batches:
            codes = b.column(0).to_numpy()
            deep = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(len(codes), 8).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top.log10(codes, deep))], names=["gram", "n", "log10"])

    return read.filter("kind = 0").select("gram", "n", "bits").mapInArrow(finished, "gram long, n long, log10 double")


# ---- counting and scoring ----


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(other columns of each row, tokens of each row) for stretches of about most bytes; text is the first column."""
    rows, lists, size = [], [], 0
    for b in batches:
        for text, *rest in zip(*b.columns, strict=True):
            value = text.as_py()
            rows.append([x.as_py() for x in rest])
            lists.append(tokens(value))
            size += len(value or "")
            if size >= most:
                yield rows, lists
                rows, lists, size = [], [], 0
    if rows:
        yield rows, lists


def spelling(lists: list[list[bytes]]) -> bytes:
    return b"".join([b" ".join(words[:-1]) + END for words in lists])


def counted(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word or null, gram or null, n) of (text, trains): counts in training rows; 0 for what only other rows have."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            n, m = len(words), len(codes)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.array(codes), pa.array(counts, pa.int64())], names=["word", "gram", "n"])

        for told_rows, lists in _blocks(batches):
            for trains in (True, False):
                own = [x for (t,), x in zip(told_rows, lists, strict=True) if bool(t) == trains]
                if trains:
                    for x in own:
                        words.update(x)
                else:
                    for w in {w for x in own for w in x}:
                        words[w] += 0
                new, n = np.unique(grams_of(spelling(own), depth), return_counts=True)
                at = np.searchsorted(codes, new)
                here = codes[np.minimum(at, len(codes) - 1)] == new if len(codes) else np.zeros(len(new), bool)
                if trains:
                    counts[at[here]] += n[here]
                codes, counts = np.insert(codes, at[~here], new[~here]), np.insert(counts, at[~here], n[~here] * trains)
            if len(words) >= HELD_WORDS or len(codes) >= 4 * HELD_WORDS:
                yield from told()
                words.clear()
                codes, counts = codes[:0], counts[:0]
        yield from told()

    return rows.select("text", "trains").mapInArrow(made, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _threshold(table: DataFrame, most: int) -> int:
    """Least power of two such that at most so many rows have n of at least that."""
    sizes = table.agg(*[F.count_if(F.col("n") >= 1 << j).alias(str(j)) for j in range(62)]).first()
    return 1 << next(j for j in range(62) if sizes[j] <= most)


class GramTable:
    """Open-addressing table of 8-byte codes and 8-byte values in two arrays, looked up many at a time."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(1, (2 * max(1, len(codes)) - 1).bit_length())
        self.codes = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        left, slots = np.arange(len(codes)), self._slots(codes)
        while len(left):
            free = self.codes[slots] == -1
            self.codes[slots[free]] = codes[left[free]]  # of several, one stays
            done = self.codes[slots] == codes[left]
            self.values[slots[done]] = values[left[done]]
            left, slots = left[~done], (slots[~done] + 1) & ((1 << self.bits) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and the places of absent codes."""
        slots = self._slots(codes)
        there = self.codes[slots]
        out = np.where(there == codes, self.values[slots], 0.0)
        left = np.nonzero((there != codes) & (there != -1))[0]
        absent = [np.nonzero(there == -1)[0]]
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            there, code = self.codes[slots], codes[left]
            hit, end = there == code, there == -1
            out[left[hit]] = self.values[slots[hit]]
            absent.append(left[end])
            more = ~(hit | end)
            left, slots = left[more], slots[more]
        return out, np.concatenate(absent)


def scored(docs: DataFrame, trains: str, id: str = "doc_id", text: str = "text", depth: int = DEPTH, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(id, trains, n_tokens, n_known, train_tokens, base_score, score, n_bytes); trains names a boolean column."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(trains), F.lit(False)).alias("trains"), F.col(id).cast("long").alias("id"))
    tallies = stored(counted(rows, depth), "tallies")
    words, grams = tallies.filter("word is not null").select("word", "n"), tallies.filter("word is null").select("gram", "n")
    known = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    total, spread = known["all"], math.log10(known["all"] + known["distinct"] + 1)
    tree = stored(weighted(grams, depth), "grams")
    often = words.filter(F.col("n") >= _threshold(words, most_words)).select(F.when(F.length("word") <= LONGEST_WORD, F.col("word")).otherwise(F.unhex(F.md5("word"))).alias("word"), "n").toArrow()
    found = dict(zip(often.column("word").to_pylist(), np.log10(often.column("n").to_numpy() + 1.0).tolist(), strict=True))
    dense = tree.filter(F.col("n") >= _threshold(tree, most_grams)).select("gram", "log10").toArrow()
    sent = spark.sparkContext.broadcast((found, GramTable(dense.column("gram").to_numpy(), dense.column("log10").to_numpy())))
    del often, found, dense

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, table = sent.value
        get = frequent.get
        for told, lists in _blocks(batches, LOOKED_UP_BYTES):
            base, known, rare, score, left = [], [], [], [], []
            spelt = [b" ".join(x[:-1]) + END for x in lists]
            codes = grams_of(b"".join(spelt), depth)
            values, absent = table.find(codes)
            ends = np.cumsum([len(x) for x in spelt])
            starts = np.concatenate([[0], ends[:-1]])
            score = np.add.reduceat(values, starts)
            absent.sort()
            cuts = np.searchsorted(absent, np.concatenate([starts, ends[-1:]]))
            for x in lists:
                each = [get(w if len(w) <= LONGEST_WORD else hashlib.md5(w).digest()) for w in x]
                there = [v for v in each if v is not None]
                base.append(math.fsum(there))
                known.append(len(there))
                rare.append([w for w, v in zip(x, each, strict=True) if v is None] if len(there) < len(x) else [])
            left = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes[absent]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[1] for t in told], pa.int64()), pa.array([t[0] for t in told]), pa.array([len(x) for x in lists], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(base, pa.float64()), pa.array(known, pa.int64()), pa.array(score), pa.array(rare, pa.list_(pa.binary())), left],
                names=["id", "trains", "n_tokens", "n_bytes", "base", "known", "score", "rare", "left"],
            )

    schema = "id long, trains boolean, n_tokens long, n_bytes long, base double, known long, score double, rare array<binary>, left array<long>"
    most = stored(rows.mapInArrow(looked_up, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    zero, none = F.lit(0.0), F.lit(0).cast("long")

    def met(column: str, key: str, table: DataFrame) -> DataFrame:
        """(row, key, the table's columns) of what the broadcast tables lack. It may still be frequent, in held-out rows alone: its own
        counts tell which keys are joined by broadcast; only those that are sought are shuffled."""
        sought = stored(most.select("row", F.explode(column).alias(key)), "sought")
        counts = sought.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
        known = stored(counts.join(table, key, "left"), "known")
        return joined_on_counted(sought, known, key, "_times", sought.count())

    more_words = met("rare", "word", words.filter("n > 0")).filter("n is not null").select("row", F.log10(F.col("n") + 1).alias("base"), F.lit(1).cast("long").alias("known"), zero.alias("score"))
    more_grams = met("left", "gram", tree.select("gram", "log10")).filter("log10 is not null").select("row", zero.alias("base"), none.alias("known"), F.col("log10").alias("score"))
    more = more_words.unionAll(more_grams).groupBy("row").agg(F.sum("base").alias("base2"), F.sum("known").alias("known2"), F.sum("score").alias("score2"))
    out = most.drop("rare", "left").join(more, "row", "left")
    score = (F.col("score") + F.coalesce("score2", zero)).alias("score")
    return out.select(
        F.col("id").alias(id), F.col("trains").alias(trains), "n_tokens", (F.col("known") + F.coalesce("known2", none)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) - F.col("n_tokens") * F.lit(spread)).alias("base_score"), score, "n_bytes", (score * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", FOLDS) != HELD_OUT).alias("trains"))
    out = scored(docs, "trains")
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
