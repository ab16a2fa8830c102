"""Prefix trie of conversations: shared beginnings, rolled up by pointer jumping.

1. Turns are laid out by range partitioning on (conversation, turn), so that one conversation may
   span many tasks. Positions, and the running digests below, are computed inside partitions; what
   a conversation carries from one partition into the next is added up from one row a partition.
2. A prefix's key is the XOR of the SHA-256 values of (position, turn) of its turns, cut to 180
   bits: a running sum that needs no pass along the conversation, and gives the parent's key by
   taking the last turn away again. Two different prefixes share a key with odds of 2^-180; this
   is no defence against somebody who plants hundreds of turns chosen for that.
3. Nodes are the distinct keys, counted by partial aggregation; each has an edge to its parent.
4. Pointer jumping: in round k every node knows the sums of its descendants nearer than 2^k and
   its ancestor 2^k above. A round adds to each node what those pointing to it have gathered, and
   lets every pointer jump. So all sums are whole after log2(depth) rounds; pointers that pass the
   root are dropped. Nodes that hold a large share of the pointers (a first turn that all
   conversations share) are joined by broadcast. Every round is stored.

Defined cases: rows without conv_id belong to no conversation and take no part; null role or text
is empty; turns are ordered by turn (null first), equal ones by the SHA-256 of role and text;
repeated rows are turns of their own; conversations of any length and number of copies are
handled; the hash of a node's ending conversations is fed by a stream of packed pieces, so its
memory is bounded; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import SPACE_CLASS, joined_on_counted, ship, stored
from inkstone.session import dropped, tables_stored

BLOCK, MOST_KEPT = 20, 4
LANES, DIGITS = 3, 15
ROOT = "0" * (LANES * DIGITS)
#: Ids of a packed piece.
PACKED = 4096

ENDS = "_part int, conv long"


def laid_out(df: DataFrame, order: list) -> DataFrame:
    """df, range-partitioned in this order, with the partition's number in _part."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def spans(local: DataFrame) -> list:
    """(_part, lo, hi) of the partitions that have rows: their first and last conversation."""
    return sorted(local.groupBy("_part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi")).collect())


def carried(local: DataFrame, parts: list, sums: dict[str, Column], add: dict) -> DataFrame:
    """(_part, conv, name...): what conversations that span partitions bring into each of them; sums are aggregates, add joins two."""
    spark = local.sparkSession
    crossing = sorted({a.hi for a, b in zip(parts, parts[1:], strict=False) if a.hi == b.lo})
    rows = []
    if crossing:
        some = local.join(F.broadcast(spark.createDataFrame([(c,) for c in crossing], "conv long")), "conv")
        so_far: dict = {}
        for r in sorted(some.groupBy("conv", "_part").agg(*[c.alias(n) for n, c in sums.items()]).collect(), key=lambda r: (r["conv"], r["_part"])):
            before = so_far.get(r["conv"])
            if before:
                rows.append((r["_part"], r["conv"], *before))
            so_far[r["conv"]] = tuple(add[n](b, r[n]) for n, b in zip(sums, before, strict=True)) if before else tuple(r[n] for n in sums)
    return spark.createDataFrame(rows, ENDS + "".join(f", before_{n} long" for n in sums))


def positioned(df: DataFrame, order: list, name: str) -> tuple[DataFrame, list]:
    """df laid out with name = 1..n inside each conversation (column conv), and the partitions' spans; order is total but for equal rows."""
    local = laid_out(df, [F.col("conv"), *order])
    parts = spans(local)
    before = carried(local, parts, {"n": F.count(F.lit(1))}, {"n": int.__add__})
    within = Window.partitionBy("_part", "conv").orderBy(*order)
    numbered = local.join(F.broadcast(before), ["_part", "conv"], "left").withColumn(name, F.row_number().over(within) + F.coalesce("before_n", F.lit(0))).drop("before_n")
    return numbered, parts


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, words): narrow rows of the turns."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)), 256)
    words = F.regexp_count(empty(text), F.lit(SPACE_CLASS.replace("[", "[^") + "+"))
    return rows.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), words.cast("long").alias("words"))


def rebuilt(rows: DataFrame, block: int = BLOCK, kept: int = MOST_KEPT) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c of turns gets the first h turns of c - c % block in place of its own, with
    h = crc32(c) % kept. Turns are (conv, part, place, digest, words) in the order of part and place; conversations (conv)."""
    rows, _ = positioned(rows, [F.col("turn").asc_nulls_first(), F.col("digest")], "place")
    rows = stored(rows.drop("_part"), "places")
    h = F.crc32(F.col("conv").cast("string")) % kept
    convs = stored(rows.filter("place = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base")), "conversations")
    # at most kept - 1 turns of a base go to each conversation of its block
    heads = rows.filter((F.col("place") < kept) & (F.col("conv") % block == 0)).select(F.col("conv").alias("base"), "place", "digest", "words")
    borrowed = convs.join(heads, "base").filter(F.col("place") <= F.col("h")).select("conv", F.lit(0).alias("part"), "place", "digest", "words")
    own = rows.filter(F.col("place") > h).select("conv", F.lit(1).alias("part"), "place", "digest", "words")
    return borrowed.unionAll(own), convs.select("conv")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, words, last): every conversation's prefixes, the empty one too; last: the whole conversation."""
    numbered, parts = positioned(rows, [F.col("part"), F.col("place")], "depth")
    term = F.sha2(F.concat(F.col("depth").cast("string"), F.lit("|"), F.col("digest")), 256)
    lanes = [f"x{k}" for k in range(LANES)]
    terms = numbered.select("_part", "conv", "depth", "words", *[F.conv(F.substring(term, 1 + DIGITS * k, DIGITS), 16, 10).cast("long").alias(x) for k, x in enumerate(lanes)])
    terms = stored(terms, "terms")
    before = carried(terms, parts, {x: F.bit_xor(x) for x in lanes}, dict.fromkeys(lanes, int.__xor__))
    following = terms.sparkSession.createDataFrame([(a["_part"], b["lo"]) for a, b in zip(parts, parts[1:], strict=False)], "_part int, following long")
    terms = terms.join(F.broadcast(before), ["_part", "conv"], "left").join(F.broadcast(following), "_part", "left")
    within, along = Window.partitionBy("_part", "conv").orderBy("depth"), Window.partitionBy("_part").orderBy("conv", "depth")
    sums = [F.bit_xor(x).over(within.rowsBetween(Window.unboundedPreceding, 0)).bitwiseXOR(F.coalesce(f"before_{x}", F.lit(0))).alias(f"y{k}") for k, x in enumerate(lanes)]
    after = F.coalesce(F.lead("conv").over(along), F.col("following"))
    summed = terms.select("conv", "depth", "words", *lanes, *sums, (after.isNull() | (after != F.col("conv"))).alias("last"))
    written = lambda cols: F.concat(*[F.lpad(F.hex(c), DIGITS, "0") for c in cols])
    key, parent = written([F.col(f"y{k}") for k in range(LANES)]), written([F.col(f"y{k}").bitwiseXOR(F.col(x)) for k, x in enumerate(lanes)])
    told = stored(summed.select("conv", F.col("depth").cast("long").alias("depth"), key.alias("key"), parent.alias("parent"), "words", "last"), "prefixes")
    ended = told.filter("last").select("conv", F.lit(False).alias("_ended"))
    root = convs.join(ended, "conv", "left").select("conv", F.lit(0).cast("long"), F.lit(ROOT), F.lit(None).cast("string"), F.lit(0).cast("long"), F.coalesce("_ended", F.lit(True)))
    return stored(told.unionAll(root), "all_prefixes")


def ends(told: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: ids are packed where they lie in order, then streamed per node."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids = None, 0, []
        piece = lambda: pa.RecordBatch.from_pydict({"key": [at], "first": pa.array([first], pa.int64()), "ids": [",".join(ids)]})
        for b in batches:
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != at or len(ids) == PACKED:
                    if ids:
                        yield piece()
                    at, first, ids = key, conv, []
                ids.append(str(conv))
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for key, ids in zip(keys, b.column(2).to_pylist(), strict=True):
                if key != at:
                    if state:
                        out.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"key": [k for k, _ in out], "ends_sha256": [h for _, h in out]})
        if state:
            yield pa.RecordBatch.from_pydict({"key": [at], "ends_sha256": [state.hexdigest()]})

    ranged = told.filter("last").select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    pieces = ranged.mapInArrow(packed, "key string, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, *values): values summed over every node's subtree, of nodes (key, parent or null, *values), by pointer jumping."""
    spark, sums = nodes.sparkSession, [F.sum(v).alias(f"_{v}") for v in values]
    state = stored(nodes.select("key", F.col("parent").alias("jump"), *values), "jumps")
    while True:
        since = tables_stored(spark) - 1
        pointed = stored(state.filter("jump is not null").groupBy(F.col("jump").alias("to")).agg(*sums, F.count(F.lit(1)).alias("n")), "pointed")
        pointing = pointed.agg(F.sum("n")).first()[0] or 0
        if not pointing:
            return state.select("key", *values)
        # where each pointer's target points to itself, with the number of pointers there
        targets = pointed.join(state.select(F.col("key").alias("to"), F.col("jump").alias("next")), "to")
        ends_at = stored(targets.select(F.col("to").alias("jump"), "next", "n"), "targets")
        jumped = joined_on_counted(state, ends_at, "jump", "n", pointing).withColumn("jump", F.col("next"))
        added = jumped.join(pointed, F.col("key") == F.col("to"), "left")
        state = stored(added.select("key", "jump", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "jumps")
        dropped(spark, since, keep=1)


def trie(told: DataFrame) -> DataFrame:
    """One row per distinct prefix of told (see prefixes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    nodes = told.groupBy("key").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.max("words").alias("words"), F.count(F.lit(1)).alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = stored(nodes.filter("parent is not null").groupBy(F.col("parent").alias("to")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    n = nodes.count()
    parents = stored(children.join(nodes.select(F.col("key").alias("to"), F.col("conv_id").alias("parent_conv_id")), "to").select(F.col("to").alias("parent"), "parent_conv_id", F.col("n_children").alias("_n")), "parents")
    counted = nodes.join(children, F.col("key") == F.col("to"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("to")
    counted = stored(counted.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "counted")
    sums = rolled_up(counted, ["n_leaves", "saved_tokens"])
    out = joined_on_counted(counted.drop("n_leaves", "saved_tokens"), parents, "parent", "_n", n).join(sums, "key").join(ends(told), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    rows, convs = rebuilt(turns(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(prefixes(rows, convs))


_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)))"""

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT h.c, 0 AS part, i, role, text FROM h JOIN t ON t.c = h.base AND t.i <= h.h
  UNION ALL SELECT t.c, 1, i, role, text FROM t JOIN h ON t.c = h.c AND t.i > h.h
), w AS (
  SELECT c, row_number() OVER o AS d, sha256(string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '') OVER o) AS k,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, count(*) OVER (PARTITION BY c) AS n
  FROM r WINDOW o AS (PARTITION BY c ORDER BY part, i)
), p AS (
  SELECT c, d, k, words, n FROM w UNION ALL SELECT h.c, 0, '', 0, coalesce(m, 0) FROM h LEFT JOIN (SELECT c, count(*) AS m FROM r GROUP BY c) USING (c)
), nodes AS (
  SELECT k, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '') AS ended FROM p GROUP BY k
), up AS (
  SELECT DISTINCT a.k AS k, b.k AS above FROM p a JOIN p b ON a.c = b.c AND b.d <= a.d
), children AS (SELECT above, count(*) AS n_children FROM up JOIN nodes x ON x.k = up.k JOIN nodes y ON y.k = above WHERE x.depth = y.depth + 1 GROUP BY above
), parents AS (SELECT up.k, y.conv_id AS parent_conv_id FROM up JOIN nodes x ON x.k = up.k JOIN nodes y ON y.k = above WHERE x.depth = y.depth + 1
), sums AS (
  SELECT up.above AS k, count(*) FILTER (n_children IS NULL)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
  FROM up JOIN nodes x ON x.k = up.k LEFT JOIN children z ON z.above = up.k GROUP BY up.above
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ended) AS ends_sha256
FROM nodes LEFT JOIN parents USING (k) LEFT JOIN children ON children.above = nodes.k JOIN sums USING (k)
"""
