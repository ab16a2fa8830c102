"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all normalised items (at most two states per item word) is built once per
block of items and broadcast; documents stream their words through it, which gives the
longest match that ends at each word. A match of ``window`` words or more, or of a whole
item that is shorter, marks its words as hit. A block holds at most ``block_words`` item
words, so what is broadcast has a proven bound however many items there are; further blocks
are further narrow passes over the same rows, without a shuffle.

Defined cases: null texts have no words; items without words match nothing; items with a
null id still mark words but are not listed; equal items are all listed; repeated document
rows are each answered; an empty benchmark leaves every document clean; other columns do not
take part. A word longer than any in the benchmark is just another unknown word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, stored

WINDOW = 10
#: Most item words in one broadcast automaton: about 2 * BLOCK_WORDS states, 200 MB in a worker.
BLOCK_WORDS = 200_000
#: Blocks whose passes run in one stage before the rows are written.
BLOCKS_A_STAGE = 4

#: Word bytes: 0-9, a-z (A-Z lower-cased) and every byte of a non-ASCII character.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; state 0 is the root."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._index(items)

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state for p's longest string followed by w; cloned off if its class also holds longer strings."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def _index(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        """at_window: for states of long strings, the state of their last window; owners: items by window; shorts: whole items that end in a state."""
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.at_window = [0] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.at_window[v] = 0 if self.length[v] < self.window else v if self.length[up] < self.window else self.at_window[up]
        self.owners: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i >= self.window - 1:
                    self.owners.setdefault(self.at_window[state], set()).add(k)
            if 0 < len(words) < self.window:
                whole.setdefault(state, []).append((len(words), k))
        self.shorts: list[list[tuple[int, int]]] = [[] for _ in order]
        for v in order[1:]:
            self.shorts[v] = self.shorts[self.link[v]] + whole.get(v, [])
        self.any_short = any(whole.values())

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [from, to) of hit words, and the numbers of items that occur."""
        moves, link, length, window, shorts, any_short = self.next, self.link, self.length, self.window, self.shorts, self.any_short
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        state = n = 0
        root = moves[0]
        for i, w in enumerate(words):
            if state:
                to = moves[state].get(w)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = moves[state].get(w)
            else:
                to = root.get(w)
            if to is None:
                continue
            state, n = to, n + 1
            reach = window if n >= window else 0
            if reach:
                seen.add(self.at_window[state])
            if any_short:
                for size, k in shorts[state]:
                    if size <= n:
                        reach = max(reach, size)
                        found.add(k)
            if reach:
                at = i + 1 - reach
                while spans and spans[-1][1] >= at:
                    at = min(at, spans.pop()[0])
                spans.append((at, i + 1))
        for s in seen:
            found |= self.owners[s]
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text less the stretches from the first to the last word of each span."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items with words, streamed to the driver in blocks of at most block_words words (or one item)."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    for item_id, text in rows.toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((item_id, words))
            size += len(words)
    yield block


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, most_covered: float | None = None) -> DataFrame:
    """docs (which must have text) plus _spans (hit words, as from, to, from, to ...), _items and _n_words.

    With most_covered, text loses its hit spans, and rows covered to a larger share are left out."""
    spark = docs.sparkSession
    out = docs.withColumns({"_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>"), "_n_words": F.lit(0).cast("long")})
    schema = out.schema
    blocks = item_blocks(benchmark, block_words)
    block, k = next(blocks), 0
    while block is not None:
        if k and k % BLOCKS_A_STAGE == 0:
            out = stored(out, "decontaminate")
        sent, after = spark.sparkContext.broadcast(block), next(blocks, None)
        limit = most_covered if after is None else None

        def scanned(batches: Iterator[pa.RecordBatch], sent=sent, limit=limit) -> Iterator[pa.RecordBatch]:
            items = sent.value
            automaton = SuffixAutomaton(items, window)
            for batch in batches:
                made = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("_spans", "_items")} | {"_n_words": []}
                whole = batch.column(batch.schema.get_field_index("text"))
                texts, kept = {}, []
                for i, text in enumerate(whole):
                    words = words_of(text.as_py())
                    made["_n_words"].append(len(words))
                    new, found = automaton.scan(words)
                    if new:
                        old = made["_spans"][i]
                        made["_spans"][i] = [x for pair in merged([*zip(old[::2], old[1::2], strict=True), *new]) for x in pair]
                        made["_items"][i] = sorted({*made["_items"][i], *(items[f][0] for f in found if items[f][0] is not None)})
                    if limit is not None and (flat := made["_spans"][i]):
                        if sum(flat[1::2]) - sum(flat[::2]) > limit * len(words):
                            continue
                        texts[i] = without(text.as_py(), list(zip(flat[::2], flat[1::2], strict=True)))
                    kept.append(i)
                if texts:
                    made["text"] = [texts.get(i, t.as_py()) for i, t in enumerate(whole)]
                done = pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(j) for j, f in enumerate(batch.schema)], schema=batch.schema)
                yield done.take(pa.array(kept, pa.int64())) if len(kept) < done.num_rows else done

        out = out.mapInArrow(scanned, schema)
        block, k = after, k + 1
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_covered: float = 0.5) -> DataFrame:
    """docs with every hit span cut out of text (n_chars follows), less those covered to more than most_covered.

    Clean rows keep their text byte for byte. Columns other than text and n_chars stay as they are."""
    own = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in own if c != "text"] or [F.lit(0).alias("none")]).alias("_rest")
    rows = matched(docs.select(rest, F.col("text").cast("string")), benchmark, window, most_covered=most_covered)
    put = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    return rows.select(*[(put[c] if c in put else F.col(f"_rest.`{c}`")).alias(c) for c in own])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, items = b.column("_spans").to_pylist(), b.column("_items").to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_words": b.column("_n_words"), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [h > 0 for h in hit],
            })

    return matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "_spans", "_items", "_n_words").mapInArrow(digested, schema)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""with d as (select doc_id, {_WORDS_SQL} as w from documents),
b as (select item_id, {_WORDS_SQL} as w from benchmark),
bw as (select distinct item_id, 10 as n, array_to_string(w[i:i + 9], ' ') as k from (select item_id, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
  union select item_id, len(w)::int as n, array_to_string(w, ' ') from b where len(w) between 1 and 9),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from
  (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from bw) where len(w) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
spread as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spread on d.doc_id = spread.doc_id left join named on d.doc_id = named.doc_id"""
