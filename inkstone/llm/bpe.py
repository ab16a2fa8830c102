"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold the merge rank of each adjacent pair of pieces (a pair that does
not merge holds NONE); the root yields the lowest rank and, among equals, its leftmost place.
A merge updates the three leaves around it in logarithmic time. A vocabulary file of the
``tokenizers`` format is read once per worker; its path is a parameter. Only the model of
this library's public word vocabulary is supported: NFC, white space to blanks, lower case,
its split pattern, byte-level letters, merges with an end-of-word suffix, no decoder.

Encoding works word by word; what a worker remembers about words is bounded (MEMORY and RECENT).
Defined cases: null counts as empty; empty texts have no ids; the special tokens' strings are
taken as their ids wherever they stand; repeated rows are each encoded; words of any length
are encoded whole in O(n log n).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents

#: Words seen twice or more, and words seen once, whose encoding a worker keeps; at its bound, either starts anew.
MEMORY, RECENT = 400_000, 200_000
#: Words longer than this are not kept.
KEPT_WORD = 64
#: Rows that are passed on together.
ROWS_A_BATCH = 500
#: Rank of a pair that does not merge.
NONE = 1 << 40
#: More than there are pieces in any vocabulary that is supported.
PIECES = 1 << 20


# Letters and digits by the regular expressions' character data, but not by the encoder's (an earlier version of the
# standard), and capitals whose lower case Python does not know yet.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7dc-a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f "
    "12550-12686 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATER_SET = "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split()) + "]"
#: Characters before this range are the same to both.
_BEYOND = re.compile("[\u0558-\U0010ffff]")


def merge_pieces(pieces: list[int], ranks: dict[int, int], results: list[int]) -> list[int]:
    """Merges the leftmost lowest-rank pair again and again until none is left.

    Pieces are numbers below PIECES; ranks has the rank of the pair a * PIECES + b, results the piece that a rank makes."""
    n, get = len(pieces), ranks.get
    if n < 2:
        return pieces
    pieces = list(pieces)
    # a leaf holds rank * n + place, so that a minimum is the leftmost of the lowest ranks
    leaves = [get(a * PIECES + b, NONE) * n + i for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))]
    none, size = NONE * n, 1 << (n - 2).bit_length()
    node = [none] * size + leaves + [none] * (size - len(leaves))
    for k in range(size - 1, 0, -1):
        left, right = node[2 * k], node[2 * k + 1]
        node[k] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, leaf: int) -> None:
        k = size + place
        node[k] = leaf
        while k > 1:
            other = node[k ^ 1]
            if other < leaf:
                leaf = other
            k >>= 1
            if node[k] == leaf:
                return
            node[k] = leaf

    while (lowest := node[1]) < none:
        rank, at = divmod(lowest, n)
        gone = after[at]
        follows = after[gone]
        made = pieces[at] = results[rank]
        pieces[gone] = -1
        after[at] = follows
        if follows < n:
            before[follows] = at
            put(gone, none)
            put(at, get(made * PIECES + pieces[follows], NONE) * n + at)
        else:
            put(at, none)
        if (past := before[at]) >= 0:
            put(past, get(pieces[past] * PIECES + made, NONE) * n + past)
    return [p for p in pieces if p >= 0]


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable in Latin-1, else from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        # pieces by number: those of the vocabulary have their ids, others numbers after them
        self.pieces = dict(self.vocab)
        number = lambda piece: self.pieces.setdefault(piece, len(self.vocab) + 1000 + len(self.pieces))
        self.ranks: dict[int, int] = {}
        self.results: list[int] = []
        for k, pair in enumerate(model["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(number(one) * PIECES + number(two), k)
            self.results.append(number(one + two))
        self.bytes = [(number(c), number(c + self.end)) for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        for known in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(known, f"[{known}--{_LATER_SET}]")
        self.careful_split = regex.compile(pattern, regex.V1)  # slower; for texts with characters of LATER
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spaces = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.tokens = [self.token.get(i, "") for i in range(max(self.token, default=-1) + 1)]
        self.decimals = [str(i) for i in range(len(self.tokens))]

    def word(self, word: str) -> bytes:
        """The ids, four bytes each, of one word of the split that is not known yet."""
        if (found := self.recent.pop(word, None)) is not None:  # seen again
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = found
            return found
        raw, letters = word.encode(), self.bytes
        pieces = [letters[b][0] for b in raw]
        pieces[-1] = letters[raw[-1]][1]
        found = array("I", [i for i in merge_pieces(pieces, self.ranks, self.results) if i in self.token]).tobytes()
        if len(word) <= KEPT_WORD:
            if len(self.recent) >= RECENT:
                self.recent.clear()
            self.recent[word] = found
        return found

    def parts(self, text: str | None) -> Iterator[bytes]:
        """Ids word by word."""
        get, word = self.known.get, self.word
        for k, part in enumerate(self.cuts.split(text or "") if self.cuts else [text or ""]):
            if k % 2:
                yield array("I", [self.special[part]]).tobytes()
                continue
            split = self.split
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                if _BEYOND.search(part):
                    part = part.translate(LATER_LOWER)
                    split = self.careful_split
            # capital sigma has one lower case here, wherever it stands
            for w in split.findall(self.spaces.sub(" ", part).replace("Σ", "σ").lower()):
                found = get(w)
                yield word(w) if found is None else found

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(text)), np.uint32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the vocabulary names no decoder. Unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids (array<int>), decoded (the text that the ids stand for); one row per row of docs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_A_BATCH):
                ids = [bpe.ids(t.as_py()).astype(np.int32) for t in b.column(1).slice(at, ROWS_A_BATCH)]
                decoded = [" ".join([bpe.tokens[i] for i in x.tolist()]) for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS_A_BATCH), pa.array([len(x) for x in ids], pa.int64()), lists, pa.array(decoded, pa.string())], names=[id, "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(made, f"`{id}` long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by blanks), decoded_sha256; one row per row of docs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path), hashlib.sha256
        tokens, decimals = bpe.tokens, bpe.decimals
        for b in batches:
            sizes, ids, decoded = [], [], []
            for t in b.column(1):
                found = bpe.encode(t.as_py())
                sizes.append(len(found))
                ids.append(sha(" ".join([decimals[i] for i in found]).encode()).hexdigest())
                decoded.append(sha(" ".join([tokens[i] for i in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(made, f"`{id}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_path())
