"""Toxicity with a linear-chain conditional random field over word tokens.

Training takes a bounded sample of labelled rows (SAMPLE_ROWS, by hash order of the id). Words
and their first 3 to 6 letters are features if tied to toxic rows significantly (binomial tail,
Benjamini-Hochberg); they mark the labelled tokens: 1 in toxic rows, 0 elsewhere. A two-state
chain is fitted to windows around such tokens and to openings of rows, by gradient ascent on the
conditional likelihood with exact forward-backward marginals. Two options go further: context
adds pairs of words (chosen alike, but apart) and the features of the words beside a token;
open_tags fits again with the tags left open, under the label of the row alone (at least one
toxic token in a toxic row, none in a clean one). README has the held-out figures of all four.

Scoring runs over every token of every whole text. Tokens without features all have the same
potentials, so stretches of them pass through a power of one 2 x 2 matrix: exact marginals cost
time in proportion to the tokens with features. Document score: a logistic function, fitted on
the same sample, of the highest marginal and of the number and share of tokens with a marginal
of one half or more. Offending offsets are the stretches of tokens with a marginal of one half or more.

Defined cases: null and empty texts have no tokens and get the score of a text without any
feature; rows without a label (or a null one) are only scored; several labels of one id count
as toxic if any is; without any toxic or any clean label, every score is the share of toxic
rows in the sample (0 without labels); repeated rows are each scored; columns other than id and
text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, fold, stored

FOLDS = 5
#: Most labelled rows that training reads.
SAMPLE_ROWS = 12_000
#: Share of false discoveries allowed among the features.
FALSE_SHARE = 0.01
#: Whether training takes pairs and neighbours as features, and fits again with open tags.
CONTEXT, OPEN_TAGS = False, False
#: Tokens to each side of a window.
REACH = 8
PREFIXES = (3, 4, 5, 6)
#: Marks of the features that the word before (after) a token lends to it.
AFTER, BEFORE = "<", ">"
#: Stands for the logarithm of a share of none.
LEAST = -9.0
_WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def pair(before: str, word: str) -> str:
    return f"{before} {word}"


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p), summed downwards from the first term."""
    if k <= 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, x = 0.0, k
    while x <= n and term > 1e-300:
        total += term
        x += 1
        term *= (n - x + 1) / x * p / (1 - p)
    return min(1.0, total)


def significant(counts: list[tuple[str, int, int]], toxic: int, clean: int, tested: int) -> list[str]:
    """Features (name, toxic rows, clean rows) whose share of toxic rows is significantly high."""
    p = toxic / (toxic + clean)
    tails = sorted((binomial_tail(a, a + b, p), -a, name) for name, a, b in counts if a > 0 and a / (a + b) > p)
    last = max((k for k, (tail, _, _) in enumerate(tails, 1) if tail <= FALSE_SHARE * k / max(tested, len(tails))), default=0)
    return [name for _, _, name in tails[:last]]


@dataclass
class Chain:
    """Two states (0 clean, 1 toxic): weights of state 1 by feature, its bias, and the log-potentials of steps."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: intercept and slopes of the document score
    link: tuple[float, ...] = (-8.0, 0.0, 0.0, 0.0)
    #: by second word, the weights of pairs by first word; made from weights
    pairs: dict[str, dict[str, float]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        for name, w in self.weights.items():
            if " " in name:
                before, word = name.split(" ")
                self.pairs.setdefault(word, {})[before] = w

    def parts(self, word: str) -> tuple[float, float, float, dict[str, float]] | None:
        """What a word adds to the log-potential of state 1: its own, that of the word after it and of the word before it, and its own
        by the word before it; None for a word without features."""
        found, pairs = [f for f in features(word) if f in self.weights], self.pairs.get(word)
        if not found and not pairs:
            return None
        total = lambda side: sum(self.weights.get(side + f, 0.0) for f in found)
        return total(""), total(AFTER), total(BEFORE), pairs or {}

    def neutral(self, n: int) -> np.ndarray:
        """n steps into tokens without features: a power of one matrix, scaled."""
        out, square = np.eye(2), np.exp(self.steps) * np.array([1.0, math.exp(self.bias)])
        square = square / square.max()
        while n:
            if n & 1:
                out = out @ square
                out /= out.max()
            square = square @ square
            square /= square.max()
            n >>= 1
        return out

    def marginals(self, places: list[int], emissions: list[float], n: int) -> list[float]:
        """Of state 1 at these places of a text of n tokens."""
        step, flat = np.exp(self.steps), math.exp(self.bias)
        ahead, at = [], -1
        state = np.ones(2)
        for place, e in zip(places, emissions, strict=True):
            if at < 0:
                state = state if place == 0 else (np.array([1.0, flat]) @ self.neutral(place - 1) if place else state)
                state = state if place == 0 else state @ step
            else:
                state = state @ self.neutral(place - at - 1) @ step
            state = state * np.array([1.0, math.exp(e)])
            state /= state.sum()
            ahead.append(state)
            at = place
        behind = self.neutral(n - 1 - at) @ np.ones(2)
        out = []
        for k in range(len(places) - 1, -1, -1):
            both = ahead[k] * behind
            out.append(float(both[1] / both.sum()))
            if k:
                behind = self.neutral(places[k] - places[k - 1] - 1) @ (step @ (np.array([1.0, math.exp(emissions[k])]) * behind))
                behind /= behind.sum()
        return out[::-1]

    def score(self, marginals: list[float], n: int) -> float:
        total = self.link[0] + sum(w * x for w, x in zip(self.link[1:], evidence(marginals, n), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def evidence(marginals: list[float], n: int) -> tuple[float, float, float]:
    """The highest marginal, and the toxic tokens (marginals of one half or more) as a logarithm and as a share of n tokens."""
    toxic = sum(m for m in marginals if m >= 0.5)
    return max(marginals, default=0.0), math.log1p(toxic), math.log((toxic + 0.01) / (n + 1)) if toxic else LEAST


def tagged(chain: Chain, text: str | None, known: dict[str, tuple | None]) -> tuple[list[int], list[float], int]:
    """Places of tokens with features, their marginals, and the number of tokens; known remembers words."""
    words = _WORD.findall(lowered(text)) if text else []
    if new := set(words).difference(known):
        if len(known) > 1_000_000:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = chain.parts(w)
    n, sums = len(words), {}
    for i in [i for i, w in enumerate(words) if known[w] is not None]:
        own, after, before, pairs = known[words[i]]
        sums[i] = sums.get(i, 0.0) + own + (pairs.get(words[i - 1], 0.0) if pairs and i else 0.0)
        if after and i + 1 < n:
            sums[i + 1] = sums.get(i + 1, 0.0) + after
        if before and i:
            sums[i - 1] = sums.get(i - 1, 0.0) + before
    places = sorted(sums)
    return places, chain.marginals(places, [chain.bias + sums[p] for p in places], n) if places else [], n


# ---- training ----


def expected(emit: np.ndarray, steps: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (windows, tokens), step marginals (windows, 2, 2) and log normalisers (windows) of padded windows."""
    n, length = emit.shape
    both = np.stack([np.zeros_like(emit), emit], axis=2)
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = both[:, 0]
    for t in range(1, length):
        into = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + both[:, t]
        ahead[:, t] = np.where(mask[:, t, None], into, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        nxt = both[:, t + 1] + behind[:, t + 1]
        back = np.stack([np.logaddexp(steps[s, 0] + nxt[:, 0], steps[s, 1] + nxt[:, 1]) for s in (0, 1)], axis=1)
        behind[:, t] = np.where(mask[:, t + 1, None], back, 0.0)
    log_z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    marginal = np.exp(ahead[:, :, 1] + behind[:, :, 1] - log_z[:, None]) * mask
    pairs = np.zeros((n, 2, 2))
    for s in (0, 1):
        for r in (0, 1):
            x = np.exp(ahead[:, :-1, s] + steps[s, r] + both[:, 1:, r] + behind[:, 1:, r] - log_z[:, None])
            pairs[:, s, r] = (x * mask[:, 1:]).sum(1)
    return marginal, pairs, log_z


def forward_backward(emit: np.ndarray, steps: np.ndarray, mask: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (windows, tokens), step marginals (2, 2) summed, log normaliser summed, of padded windows that occur so many times."""
    times = np.ones(len(emit)) if times is None else times
    marginal, pairs, log_z = expected(emit, steps, mask)
    return marginal, (pairs * times[:, None, None]).sum(0), float((log_z * times).sum())


def row_slopes(emit: np.ndarray, steps: np.ndarray, mask: np.ndarray, rows: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Slopes by emission and by step, and value, of the log-likelihood of rows whose tags are open.

    rows numbers each window's row, toxic and times are by row. A clean row is one path, all zero, of probability p; a toxic row is
    every other path. Both slopes are expectations less those of that path, times -1 or p / (1 - p)."""
    marginal, pairs, log_z = expected(emit, steps, mask)
    stays = mask[:, 1:].sum(1)
    log_p = np.minimum(np.bincount(rows, weights=steps[0, 0] * stays - log_z, minlength=len(toxic)), -1e-9)
    factor = np.where(toxic, 1 / np.expm1(-np.maximum(log_p, -600.0)), -1.0) * times
    value = float((times * np.where(toxic, np.log(-np.expm1(log_p)), log_p)).sum())
    pairs[:, 0, 0] -= stays
    return marginal * factor[rows][:, None], (pairs * factor[rows][:, None, None]).sum(0), value


def refined(groups: list[tuple[bool, list[list[list[int]]], int]], n_features: int, start: np.ndarray, rounds: int = 80, penalty: float = 0.02) -> np.ndarray:
    """start (weights, bias, steps) moved by Adam on the penalised likelihood of the labels of rows (toxic, windows, how often)."""
    windows = [(g, w) for g, (_, ws, _) in enumerate(groups) for w in ws]
    toxic, times = np.array([t for t, _, _ in groups], bool), np.array([x for _, _, x in groups], np.float64)
    rows = np.array([g for g, _ in windows], np.int64)
    n, length = len(windows), max(len(w) for _, w in windows)
    mask = np.arange(length) < np.array([len(w) for _, w in windows])[:, None]
    cells = np.array([(i, j, f) for i, (_, w) in enumerate(windows) for j, fs in enumerate(w) for f in fs], np.int64).reshape(-1, 3).T
    at = start.copy()
    first, second = np.zeros_like(at), np.zeros_like(at)
    for k in range(1, rounds + 1):
        emit = np.full((n, length), at[n_features])
        np.add.at(emit, (cells[0], cells[1]), at[cells[2]])
        off, steps, _ = row_slopes(emit, at[n_features + 1 :].reshape(2, 2), mask, rows, toxic, times)
        slope = np.concatenate([np.bincount(cells[2], weights=off[cells[0], cells[1]], minlength=n_features), [off.sum()], steps.ravel()]) - penalty * at
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at = at + 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return at


def fitted(windows: list[tuple[list[list[int]], list[int], int]], n_features: int, rounds: int = 120, penalty: float = 0.02) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and steps from (feature numbers of each token, tags, how often) by Adam on the penalised likelihood."""
    n, length = len(windows), max(len(t) for _, t, _ in windows)
    times = np.array([x for _, _, x in windows], np.float64)
    mask, tags = np.zeros((n, length), bool), np.zeros((n, length))
    rows, columns, names = [], [], []
    for i, (tokens, ys, _) in enumerate(windows):
        mask[i, : len(ys)] = True
        tags[i, : len(ys)] = ys
        for j, fs in enumerate(tokens):
            rows += [i] * len(fs)
            columns += [j] * len(fs)
            names += fs
    rows, columns, names = (np.array(x, np.int64) for x in (rows, columns, names))
    seen = np.zeros((2, 2))
    for s in (0, 1):
        for r in (0, 1):
            seen[s, r] = (((tags[:, :-1] == s) & (tags[:, 1:] == r) & mask[:, 1:]) * times[:, None]).sum()
    at = np.concatenate([np.zeros(n_features), [-3.0], np.zeros(4)])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for k in range(1, rounds + 1):
        weights, bias, steps = at[:n_features], at[n_features], at[n_features + 1 :].reshape(2, 2)
        emit = np.full((n, length), bias)
        np.add.at(emit, (rows, columns), weights[names])
        marginal, pair, _ = forward_backward(emit, steps, mask, times)
        off = (tags * mask - marginal) * times[:, None]
        slope = np.concatenate([np.bincount(names, weights=off[rows, columns], minlength=n_features), [off.sum()], (seen - pair).ravel()]) - penalty * at
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at = at + 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return at[:n_features], float(at[n_features]), at[n_features + 1 :].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Newton steps for an intercept and slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    at = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(at))
        at = at + np.linalg.solve(curve, x.T @ (y - p) - penalty * at)
    return at


def sampled(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most rows labelled ids of docs, by hash order; the ids are broadcast."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")


def trained(sample: DataFrame, context: bool = CONTEXT, open_tags: bool = OPEN_TAGS) -> Chain:
    """A chain from (text, toxic); what reaches the driver is bounded by the sample.

    context adds pairs and the features of the words beside a token, open_tags the second fit, under the labels of rows alone."""
    sample = stored(sample, "sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        share = 1.0 if toxic else 0.0
        return Chain(link=(40.0 * share - 20.0, 0.0, 0.0, 0.0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0), b.column(1), strict=True):
                words = _WORD.findall(lowered(text.as_py() or ""))
                (own if y.as_py() else other).update({f for w in set(words) for f in features(w)}.union(map(pair, words, words[1:]) if context else ()))
        names = sorted({*own, *other})
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "a": pa.array([own[f] for f in names], pa.int64()), "b": pa.array([other[f] for f in names], pa.int64())})

    counts = stored(sample.mapInArrow(counted, "name string, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
    chosen: dict[str, int] = {}
    for kind in ("not contains(name, ' ')", "contains(name, ' ')")[: 1 + context]:
        tested = counts.filter(f"a + b >= 3 and {kind}").count()
        found = [tuple(r) for r in counts.filter(f"a >= 3 and a * {clean} > 3 * b * {toxic} and {kind}").collect()]
        chosen |= {f: k for k, f in enumerate(significant(found, toxic, clean, tested), len(chosen))}
    names = [*chosen, *(side + f for side in (AFTER, BEFORE) if context for f in chosen if " " not in f)]
    number = {f: k for k, f in enumerate(names)}

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, list[dict]]] = []
            for text, y in zip(b.column(0), b.column(1), strict=True):
                words, y = _WORD.findall(lowered(text.as_py() or "")), y.as_py()
                own = [[f for f in features(w) if f in chosen] for w in words]
                tokens = [[number[f] for f in fs] for fs in own]
                for i, p in enumerate(map(pair, words, words[1:])):
                    if p in chosen:
                        tokens[i + 1].append(number[p])
                hits, at = [i for i, t in enumerate(tokens) if t], 0
                marked = {i for i in hits if y}
                for i, fs in enumerate(own if context else ()):
                    if i + 1 < len(words):
                        tokens[i + 1] += [number[AFTER + f] for f in fs]
                    if i:
                        tokens[i - 1] += [number[BEFORE + f] for f in fs]
                windows = []
                for i in [REACH, *hits]:
                    if i >= at:
                        a, z = max(at, i - REACH), min(len(words), i + REACH + 1)
                        if z > a:
                            windows.append({"tokens": [sorted(t) for t in tokens[a:z]], "tags": [int(k in marked) for k in range(a, z)]})
                        at = z
                out += [(y, windows)] if y and windows else [(y, [w]) for w in windows]
            kind = pa.list_(pa.struct([("tokens", pa.list_(pa.list_(pa.int32()))), ("tags", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind)], names=["toxic", "windows"])

    windows = sample.mapInArrow(windowed, "toxic int, windows array<struct<tokens:array<array<int>>,tags:array<int>>>")
    # a toxic row keeps its windows together, a clean one is as many rows; equal ones count as often as they occur; their order fixes the sums
    groups = sorted(tuple(r) for r in windows.groupBy("toxic", "windows").agg(F.count(F.lit(1)).alias("n")).collect())
    chain = Chain()
    if chosen and groups:
        weights, bias, steps = fitted([(w["tokens"], w["tags"], n) for _, ws, n in groups for w in ws], len(names))
        at = np.concatenate([weights, [bias], steps.ravel()])
        if open_tags:
            at = refined([(bool(y), [w["tokens"] for w in ws], n) for y, ws, n in groups], len(names), at)
        chain = Chain({f: float(at[k]) for f, k in number.items()}, float(at[len(names)]), at[len(names) + 1 :].reshape(2, 2))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple | None] = {}
        for b in batches:
            all_told = [evidence(*tagged(chain, t.as_py(), known)[1:]) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in all_told], pa.float64()) for k in range(3)), b.column(1)], names=["x1", "x2", "x3", "toxic"])

    rows = sample.mapInArrow(seen, "x1 double, x2 double, x3 double, toxic int").collect()
    x = np.array([tuple(r)[:3] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    order = np.lexsort((y, *x.T))
    chain.link = tuple(float(v) for v in logistic(x[order], y[order]))
    return chain


def scored(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted, spans): spans are offsets (from, to, marginal) in code points of offending stretches."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple | None] = {}
        for b in batches:
            scores, spans = [], []
            for t in b.column(1):
                whole = t.as_py()
                places, marginals, n = tagged(chain, whole, known)
                scores.append(chain.score(marginals, n))
                bad = {p: m for p, m in zip(places, marginals, strict=True) if m >= 0.5}
                these: list[dict] = []
                if bad:
                    last = -2
                    for i, m in enumerate(_WORD.finditer(lowered(whole))):
                        if i in bad:
                            if i == last + 1:
                                these[-1] |= {"to": m.end(), "marginal": max(these[-1]["marginal"], bad[i])}
                            else:
                                these.append({"from": m.start(), "to": m.end(), "marginal": bad[i]})
                            last = i
                spans.append(these)
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)], names=[id, "score", "predicted", "spans"])

    rows = docs.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(made, f"`{id}` long, score double, predicted int, spans array<struct<`from`:int,`to`:int,marginal:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", FOLDS) != 0)
    chain = trained(sampled(docs, labels))
    out = scored(docs, chain)
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"), "spans")
