"""SimHash near-duplicates with pivot distance tables.

1. Every text gets a 64-bit fingerprint; equal fingerprints become one row.
2. A row's Hamming distances to 72 reference fingerprints are computed once: to a base, to the 64
   fingerprints that differ from the base in one bit, and to 7 more scattered ones. Taken
   relative to the base's, the coordinates of the 64 come in bits + 2 families of neighbouring
   bits. Two fingerprints within ``bits`` of each other differ in ``bits`` of these coordinates at
   most, so they agree in all coordinates of at least two families, and meet in the cell that
   these name: every choice of two families is one cell of a row.
3. In a cell, rows are sorted by their distance to the base; pairs whose distances to any
   scattered reference differ by more than ``bits`` are discarded, survivors verified by their
   exact Hamming distance. A cell returns a spanning forest of its links, never all its pairs.
   Cells above ``tile`` rows are cut in tiles that meet pairwise in separate tasks, so no task
   grows with a hot cell.
4. Components of the links give the classes.

Every link between different fingerprints within ``bits`` is found (pigeonhole and triangle
inequality are exact). Defined cases: null and empty texts have fingerprint zero and link
like any other; null ids take part but lose to any other id; repeated rows are all returned;
texts of any length are hashed in stretches of bounded memory; an empty table gives an empty
result; only the id and text columns are read.

The pipeline's stage compares sets of five-word shingles (see ``deduplicated``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, stored
from inkstone.operators.graph import components

SHINGLE, BITS, SEED = 3, 2, 42
#: Scattered references, from a fixed rule (hashes of 1, 2, ...); the first is the base of the one-bit references.
PIVOTS = tuple(xxhash.xxh64_intdigest(str(k).encode(), SEED) for k in range(1, 9))
TILE = 20_000
#: Shingles whose hashes are held at a time.
STRETCH = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles; a text of fewer words is one shingle, of none is 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for at in range(0, n, STRETCH):
        own = words[at : at + STRETCH + shingle - 1]
        joined = b" ".join(own)
        starts = [0, *itertools.accumulate(len(w) + 1 for w in own)]
        hashed = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[min(shingle, len(own)) :], strict=False)]
        total += np.unpackbits(np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "id long, fp long")


def families(bits: int) -> list[tuple[int, int]]:
    """Ranges of the one-bit references: two of these families at least agree for any two fingerprints within bits."""
    return list(itertools.pairwise(64 * k // (bits + 2) for k in range(bits + 3)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(reference: int):
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(reference))))


def _packed_distances():
    """Distances to the eight scattered references, a byte each."""
    packed = F.lit(0).cast("long")
    for k, p in enumerate(PIVOTS):
        packed = packed.bitwiseOR(F.shiftleft(_distance(p).cast("long"), 8 * k))
    return packed


def pivot_table(rows: DataFrame) -> DataFrame:
    """rows (node, fp) with d, the packed distances to the scattered references, and c, those to the 64 one-bit references
    relative to the base's."""
    near = F.array(*[(_distance(PIVOTS[0] ^ (1 << (63 - k))) - _distance(PIVOTS[0])).cast("byte") for k in range(64)])
    return rows.select("node", "fp", _packed_distances().alias("d"), near.alias("c"))


class Forest:
    """Union-find over row numbers, with vectorised finding."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                return at
            at = above

    def join(self, a: int, b: int) -> bool:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, packed: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside equal keys; rows are sorted by key and first coordinate."""
    n, forest, links = len(fps), Forest(len(fps)), []
    coords = packed.view(np.uint8).reshape(n, 8).astype(np.int16)
    left, step = np.arange(n), 0
    while len(left):
        step += 1
        left = left[left + step < n]
        right = left + step
        near = (keys[left] == keys[right]) & (coords[right, 0] - coords[left, 0] <= bits)
        left = left[near]
        a = left
        for k in range(1, 8):
            a = a[np.abs(coords[a, k] - coords[a + step, k]) <= bits]
        a = a[np.bitwise_count((fps[a] ^ fps[a + step]).view(np.uint64)) <= bits]
        a = a[forest.roots(a) != forest.roots(a + step)]
        links += [(int(nodes[i]), int(nodes[i + step])) for i in a.tolist() if forest.join(i, i + step)]
    return links


def links(rows: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between nodes that connect all linked rows (node, fp); at most rows - 1 edges of each cell."""
    cells = [F.xxhash64(F.slice("c", a + 1, b - a), F.slice("c", x + 1, y - x)) for (a, b), (x, y) in itertools.combinations(families(bits), 2)]
    keyed = pivot_table(rows).select("node", "fp", "d", F.posexplode(F.array(*cells)).alias("choice", "key"), F.lit(0).cast("long").alias("part"))
    large = keyed.groupBy("choice", "key").agg(F.count("fp").alias("n")).filter(F.col("n") > tile)
    large = stored(large, "large")
    if not large.isEmpty():
        tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("long")
        own = F.pmod(F.xxhash64("node"), F.col("t"))
        parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("t") - 1), lambda o: F.least(o, F.col("own")) * F.col("t") + F.greatest(o, F.col("own")))
        keyed = keyed.drop("part").join(large, ["choice", "key"], "left").withColumn("t", tiles).withColumn("own", own).select("node", "fp", "d", "choice", "key", F.explode(parts).alias("part"))
    # xxhash64 of the three names the bucket; a clash only makes a bucket larger
    dealt = keyed.select(F.xxhash64("choice", "key", "part").alias("key"), "node", "fp", "d")
    dealt = dealt.repartition("key").sortWithinPartitions("key", F.col("d").bitwiseAND(F.lit(255)))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            whole = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                found = bucket_links(*[h[:whole] for h in held], bits)
                held = [h[whole:] for h in held]
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.mapInArrow(linked, "a long, b long").distinct()


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id): component_id is the least id in the class (null only if all its ids are)."""
    rows = stored(fingerprints(docs, id, text, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    edges = links(distinct.select(F.col("fp").alias("node"), "fp"), bits, tile)
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return rows.join(members, "fp").select("id", "fp", "component_id")


# ---- near copies of whole documents ----

#: Near copies: sets of five-word shingles with a Jaccard similarity of at least 4/5.
WORDS, LEAST = 5, (4, 5)
#: Documents whose shingles are counted, and shingles counted as common; both only decide an order, not the result.
SAMPLED, COMMON = 20_000, 100_000
#: Cells of a sketch for each shingle (at least), and bits of the fingerprint that a sketch folds to.
CELLS, FOLDED = 4, 1024
#: References of a key's pivot table.
REFERENCES = 8


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 hashes of all five-word shingles; fewer words are one shingle, no words none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    parts = [joined] if len(words) <= WORDS else {joined[a : b - 1] for a, b in zip(starts, starts[WORDS:], strict=False)}
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(p, SEED) for p in parts]), np.uint64))


def alike(shared, a, b):
    """Whether sets of sizes a and b with so many elements in common have a Jaccard similarity of LEAST or more."""
    return shared * (LEAST[0] + LEAST[1]) >= LEAST[0] * (a + b)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the number of hashes in each of a number of cells: a power of two, CELLS times the hashes or FOLDED at least."""
    cells = max(FOLDED, 1 << max(0, CELLS * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(sketched: bytes) -> bytes:
    """The sketch's fingerprint of FOLDED bits: the parities over cells that agree in their last bits.

    The Hamming distance of two fingerprints is at most the number of shingles that are not in common."""
    return np.bitwise_xor.reduce(np.frombuffer(sketched, np.uint8).reshape(-1, FOLDED // 8), axis=0).tobytes()


def sketches_allow(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only for sets that are no near copies: cells of different parity are at most as many as elements not in common."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return apart <= na + nb and alike((na + nb - apart) // 2, na, nb)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that repeat in a sample of the texts, the most frequent COMMON, and their counts."""
    text = F.col("text").cast("string")
    rate = max(1, docs.count() // SAMPLED)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], names=["s"])

    sampled = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0)
    counted = sampled.mapInArrow(shingles, "s long").groupBy("s").agg(F.count("s").alias("n")).filter("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, n = counted.column("s").to_numpy().astype(np.int64).view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles, rare ones first, of which two near copies share one at least; and the number that are not common."""
    n = len(hashes)
    if not n:
        return hashes, 0
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    often = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(n, np.int64)
    first = np.lexsort((hashes, often))[: n - -(-LEAST[0] * n // LEAST[1]) + 1]
    return hashes[first], int((often == 0).sum())


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns (key first, sorted by it) in pieces of whole keys, less the keys of one row."""
    held: list[np.ndarray] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = [np.concatenate(two) for two in zip(held, columns, strict=True)] if held else columns
        if not held or not len(held[0]):
            continue
        whole = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
        if whole:
            key = held[0][:whole]
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            shared = same[1:] | same[:-1]
            yield [h[:whole][shared] for h in held]
            held = [h[whole:] for h in held]


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]]) if len(key) else np.zeros(1, np.int64)


def _may_be_alike(n: np.ndarray, at: np.ndarray, a, b) -> np.ndarray:
    """Upper bound for rows a, b whose first common shingle stands at places at of their n; of a later one it may say no."""
    return alike(np.minimum(n[a] - at[a], n[b] - at[b]), n[a], n[b])


def shared_prefixes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, at, centre, before): nodes by each shingle of their prefix that others have there too; and pairs (a, b).

    Rows are range-partitioned on a total order by key, so a hot key spans many tasks, and each task streams over its rows.
    In a task, centre is the first node of a key (the one with the fewest rare shingles) and before the one before it; the pairs
    join a key's stretches in neighbouring tasks (one at most for each task)."""
    order = ["key", "rare", "n", "node"]
    keyed = nodes.select("node", "n", "rare", F.posexplode("prefix").alias("at", "key")).select("key", "node", F.col("n").cast("long"), F.col("at").cast("long"), "rare")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, none = TaskContext.get().partitionId(), np.empty(0, np.int64)
        held, centre, first = [none] * 4, 0, True
        begun = False  # whether the first held row goes on with a key that was passed on before

        def told(key, node, n, at, last: bool) -> pa.RecordBatch:
            nonlocal centre, begun, first
            runs = _runs(key)
            start = np.repeat(runs[:-1], np.diff(runs))
            centres, before = node[start], node[np.maximum(np.arange(len(key)) - 1, start)]
            if begun:
                centres[: runs[1]] = centre
            same = np.concatenate([[begun], key[1:] == key[:-1], [False]])
            keep = same[1:] | same[:-1]
            edge = np.zeros(len(key), np.int32)
            edge[0] += int(first)
            edge[-1] += 2 * int(last)
            keep |= (key == key[0]) & first | (key == key[-1])  # these may go on in another task, or in the next piece
            centre, begun, first = int(centres[-1]), False, False
            columns = [key, node, n, at, centres, before, np.full(len(key), part, np.int32), edge]
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["key", "node", "n", "at", "centre", "before", "part", "edge"])

        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            if b is None and len(held[0]):
                yield told(*held, last=True)
            elif len(held[0]) > 1:
                yield told(*[h[:-1] for h in held], last=False)  # the last row stays: it may be the task's last
                begun = bool(held[0][-1] == held[0][-2])
                held = [h[-1:] for h in held]

    schema = "key long, node long, n long, at long, centre long, before long, part int, edge int"
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "node", "n", "at")
    shared = stored(spread.mapInArrow(found, schema), "shared")
    edges = sorted((r["part"], -(r["edge"] & 1), r["edge"], r["key"], r["node"]) for r in shared.filter("edge > 0").select("part", "edge", "key", "node").collect())
    across = [(x[4], y[4]) for x, y in itertools.pairwise(edges) if x[2] & 2 and y[2] & 1 and x[3] == y[3] and x[4] != y[4]]
    return shared.drop("part", "edge"), nodes.sparkSession.createDataFrame([(min(p), max(p)) for p in across], "a long, b long")


def dealt(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """rows (key, node, root and more) of keys with several roots, with part: two rows of different roots of a key meet in a part.

    Rows of a key of over tile rows are cut into tiles of its largest root and tiles of all others; the former meet the
    latter, and the latter each other, so a hot key whose rows are nearly all connected stays linear."""
    keys = stored(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("node").alias("k")).filter("low < high").select("key", "k"), "open")
    large = keys.filter(F.col("k") > tile)
    small = rows.join(keys.filter(F.col("k") <= tile).select("key"), "key").withColumn("part", F.lit(0).cast("long"))
    if large.isEmpty():
        return small
    held = rows.join(large, "key")
    main = held.groupBy("key", "k", "root").agg(F.count("node").alias("m")).groupBy("key", "k").agg(F.max(F.struct("m", "root")).alias("main"))
    tiles = lambda n: F.greatest(F.ceil(n / tile), F.lit(1)).cast("long")
    main = main.select("key", F.col("main.root").alias("most"), tiles(F.col("main.m")).alias("tm"), tiles(F.col("k") - F.col("main.m")).alias("to"))
    held, zero = rows.join(main, "key"), F.lit(0).cast("long")
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("most"), F.col("tm")).otherwise(F.col("to"))))
    of_most = F.transform(F.sequence(zero, F.col("to") - 1), lambda j: F.col("own") * F.col("to") + j)
    of_rest = F.concat(
        F.transform(F.sequence(zero, F.col("tm") - 1), lambda i: i * F.col("to") + F.col("own")),
        F.transform(F.sequence(zero, F.col("to") - 1), lambda o: -1 - F.least(o, F.col("own")) * F.col("to") - F.greatest(o, F.col("own"))),
    )
    parts = F.explode(F.when(F.col("root") == F.col("most"), of_most).otherwise(of_rest)).alias("part")
    return small.unionByName(held.select(*rows.columns, parts))


def _near(n: np.ndarray, fps: np.ndarray, a, b) -> np.ndarray:
    """Whether fingerprints allow near copies: their distance is at most the number of shingles that are not in common."""
    apart = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=-1, dtype=np.int64)
    return apart * (LEAST[0] + LEAST[1]) <= (n[a] + n[b]) * (LEAST[1] - LEAST[0])


def key_pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows of other roots) that may be near copies, of the rows of one key in the order of root.

    A pivot table of distances to some of the rows goes first: pairs whose coordinates differ by more than near copies may are
    discarded, the others compared by their own distance. Rows of the largest root are never compared with each other."""
    runs = _runs(root)
    size = np.repeat(np.diff(runs), np.diff(runs))
    order = np.lexsort((root, size))
    n, at, root, fps, total = n[order], at[order], root[order], fps[order], len(order)
    ends = np.repeat(_runs(root)[1:], np.diff(_runs(root)))
    pivots = np.linspace(0, total - 1, REFERENCES).astype(np.int64) if total > 2 * REFERENCES else np.empty(0, np.int64)
    table = np.stack([np.bitwise_count(fps ^ fps[p]).sum(axis=1, dtype=np.int64) for p in pivots], axis=1) if len(pivots) else None
    for i in range(total - int(size.max())):
        others = np.arange(ends[i], total)
        others = others[_may_be_alike(n, at, i, others)]
        if table is not None and len(others):
            others = others[np.abs(table[others] - table[i]).max(axis=1) * (LEAST[0] + LEAST[1]) <= (n[others] + n[i]) * (LEAST[1] - LEAST[0])]
        if len(others):
            others = others[_near(n, fps, i, others)]
        if len(others):
            yield order[i], order[others]


def pairs_apart(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): every two nodes of rows (key, node, n, at, root, fp) with a common key and different roots that may be near copies."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, at, root, *words in _by_key(_unpacked(batches)):
            fps = np.stack(words, axis=1).view(np.uint64)
            runs = _runs(key)
            lengths = np.diff(runs)
            two = runs[:-1][lengths == 2]  # most keys have two rows: all of these at once
            two = two[root[two] != root[two + 1]]
            two = two[_may_be_alike(n, at, two, two + 1)]
            two = two[_near(n, fps, two, two + 1)]
            a, b = [node[two]], [node[two + 1]]
            for lo, hi in zip(runs[:-1][lengths > 2].tolist(), runs[1:][lengths > 2].tolist(), strict=True):
                if root[lo] != root[hi - 1]:
                    for i, others in key_pairs(n[lo:hi], at[lo:hi], root[lo:hi], fps[lo:hi]):
                        a.append(np.full(len(others), node[lo + i]))
                        b.append(node[lo + others])
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    met = dealt(rows, tile).select(F.xxhash64("key", "part").alias("key"), "node", "n", "at", "root", "fp")
    return met.repartition("key").sortWithinPartitions("key", "root").mapInArrow(found, "a long, b long").distinct()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, binary fingerprints, as columns of 64 bits."""
    for b in batches:
        words = np.frombuffer(b"".join(b.columns[-1].to_pylist()), np.int64).reshape(b.num_rows, FOLDED // 64)
        columns = [*b.columns[:-1], *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])


def allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches allow a near copy."""
    own = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (c.to_pylist() for c in batch.columns[2:])
            kept = pa.array([sketches_allow(*two) for two in zip(x, y, na, nb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return both.mapInArrow(kept, "a long, b long")


def texts_of(pairs: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(node, text) of the nodes in pairs, from own (id, text_hash, text)."""
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    named = nodes.select("id", "text_hash", "node").join(asked, "node", "left_semi")
    return own.join(named, ["id", "text_hash"]).select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes (node, text) whose whole shingle sets are near copies."""
    own = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "text_a", "text_b")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            near = []
            for a, b, x, y in zip(*batch.columns, strict=True):
                sets = []
                for node, text in ((a.as_py(), x), (b.as_py(), y)):
                    if node not in held:
                        if len(held) > 500:
                            held.clear()
                        held[node] = shingle_set(text.as_py())
                    sets.append(held[node])
                near.append(alike(len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]), len(sets[1])))
            kept = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return both.mapInArrow(tested, "a long, b long")


def deduplicated(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """docs less all but one row of each group of near copies: the one of the least doc_id stays.

    Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are
    connected. The result is exact: near copies share one of the first n - ceil(0.8 n) + 1 of their n shingles in any order
    of all shingles (here rare ones first), so texts meet by these. A fingerprint of shingle parities bounds the number of
    shingles two texts do not share from below by its Hamming distance, and pivot tables of such distances bound that again;
    only links verified on the whole sets connect. A first round tests each text against two others of a key and connects
    large groups; a second one finds all pairs that are still apart. Columns stay as they are. Null ids give way to others;
    null and empty texts and texts without words are copies of each other."""
    no_id = (1 << 63) - 1
    common, counts = _common(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, rare, prefixes, sketches, fps = [], [], [], [], [], []
            for t in b.column(2):
                hashes = shingle_set(t.as_py())
                first, unseen = _prefix(hashes, common, counts)
                node.append(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED))
                n.append(len(hashes))
                rare.append(unseen)
                prefixes.append(first.view(np.int64))
                sketches.append(sketch(hashes))
                fps.append(folded(sketches[-1]))
            cuts = np.cumsum([0, *map(len, prefixes)])
            prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            columns = [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), prefix, pa.array(sketches, pa.binary()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "n", "rare", "prefix", "sketch", "fp"])

    text = F.col("text").cast("string")
    id, text_hash = F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id)), F.xxhash64(F.coalesce(text, F.lit("")))
    own = docs.select(id.alias("id"), text_hash.alias("text_hash"), text.alias("text"))
    rows = own.mapInArrow(hashed, "id long, text_hash long, node long, n long, rare long, prefix array<long>, sketch binary, fp binary")
    least = rows.groupBy("node").agg(F.min(F.struct("id", "text_hash", "n", "rare", "prefix", "sketch", "fp")).alias("first"))
    nodes = stored(least.select("node", "first.*"), "nodes")
    shared, across = shared_prefixes(nodes)
    ordered = lambda b: shared.select(F.least("node", b).alias("a"), F.greatest("node", b).alias("b")).filter("a < b")
    tried = stored(ordered("centre").unionAll(ordered("before")).unionAll(across).distinct(), "tried")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        likely = stored(allowed(pairs, nodes), f"likely-{name}")
        return stored(verified(likely, stored(texts_of(likely, nodes, own), f"texts-{name}")), f"near-{name}")

    near = linked(tried, "first")
    roots = stored(components(near), "roots")
    apart = shared.select("key", "node", "n", "at").join(nodes.select("node", "fp").join(roots, "node", "left"), "node").withColumn("root", F.coalesce("root", "node"))
    near = near.unionAll(linked(pairs_apart(apart, tile).join(tried, ["a", "b"], "left_anti"), "rest"))
    named = nodes.join(components(near), "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("id", "text_hash").alias("first"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_kept_id"), F.col("first.text_hash").alias("_kept_hash"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), id.alias("_kept_id"), text_hash.alias("_kept_hash"))
    # a repeated row of the same id and text is a copy too
    return whole.join(kept, ["_kept_id", "_kept_hash"]).dropDuplicates(["_kept_id", "_kept_hash"]).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
