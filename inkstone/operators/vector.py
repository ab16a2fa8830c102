"""Embeddings, similarity pairs, top-k search and retrieval with a lexical fallback."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.lexicons import KEY_PHRASES, STOPWORDS
from inkstone.session import stored, table_exists

#: Rows of a tile of the pairwise comparison, rows of a list of the search (more are striped), and queries that a task holds.
TILE, CAPACITY, QUERIES = 8192, 65536, 4096
#: Rows that a step compares or sends at a time, and pairs that it holds: its memory, whatever the batches and the number of tiles.
HELD, PAIRS = 1024, 1 << 18
#: Rows whose means are the lists' centres, and lists at most.
SAMPLE, MOST_LISTS = 8192, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hashed_vectors(texts: pd.Series, size: int = 64) -> pd.Series:
    """A stand-in for a sentence model: unit vectors of signed word counts at places given by a checksum; null without words."""
    place: dict[str, int] = {}

    def vector(text: str | None) -> np.ndarray | None:
        words = _WORDS.findall(text.lower()) if text else []
        if not words:
            return None
        for w in words:
            if w not in place:
                place[w] = zlib.crc32(w.encode()) % (2 * size)
        counts = np.bincount([place[w] for w in words], minlength=2 * size).astype(np.float64)
        v = counts[:size] - counts[size:]
        norm = np.linalg.norm(v)
        return v / norm if norm > 0 else v

    return texts.map(vector)


_WORDS = re.compile(r"\w+")


def letter_vectors(texts: pd.Series) -> pd.Series:
    """Unit vectors of the counts of the letters a to z; null without any. Small enough for SQL to check."""
    out: list[np.ndarray | None] = []
    for first in range(0, len(texts), 1024):
        codes = [(t or "").lower().encode("ascii", "ignore") for t in texts.iloc[first : first + 1024]]
        # the letters of all these texts are counted in one go, 128 places a text
        places = np.repeat(np.arange(len(codes)) * 128, [len(c) for c in codes]) + np.frombuffer(b"".join(codes), np.uint8)
        counts = np.bincount(places, minlength=128 * len(codes)).reshape(-1, 128)[:, 97:123].astype(np.float64)
        norms = np.sqrt((counts**2).sum(1))
        units = counts / np.where(norms > 0, norms, 1)[:, None]
        out += [v if n else None for v, n in zip(units, norms, strict=True)]
    return pd.Series(out, texts.index, dtype=object)


def embedded(rows: DataFrame, text: str, embed: Callable[[pd.Series], pd.Series] = hashed_vectors) -> DataFrame:
    """rows with embedding; embed maps a batch of texts to vectors."""

    @F.pandas_udf("array<double>")
    def vectors(batch: pd.Series) -> pd.Series:
        return embed(batch)

    return rows.withColumn("embedding", vectors(F.col(text)))


_CACHED = "key string, embedding array<double>"


def embedded_once(texts: DataFrame, text: str, path: str, embed: Callable[[pd.Series], pd.Series] = hashed_vectors) -> int:
    """Adds (key, embedding) of those distinct texts that the cache at path lacks, key their SHA-256, and tells how many they were.

    Texts go from the shuffle that finds the distinct ones straight to the cache, and are stored nowhere else. A run's new vectors
    are appended as one write; whoever loses an executor meanwhile has them embedded again, never twice in the table."""
    spark = texts.sparkSession
    keyed = texts.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("key"), F.col(text).alias("_text"))
    wanted, before = keyed.groupBy("key").agg(F.any_value("_text").alias("_text")), 0
    if table_exists(spark, path):
        known = spark.read.schema(_CACHED).parquet(path)
        wanted, before = wanted.join(known.select("key"), "key", "left_anti"), known.count()
    embedded(wanted, "_text", embed).select("key", "embedding").write.mode("append").parquet(path, compression="zstd")
    return spark.read.schema(_CACHED).parquet(path).count() - before


def cached_embeddings(texts: DataFrame, text: str, path: str, embed: Callable[[pd.Series], pd.Series] = hashed_vectors) -> tuple[DataFrame, int]:
    """(key, embedding) of the distinct texts, key their SHA-256, and how many of them had to be embedded.

    The cache is a table in the shared folder at path: texts that are in it, from any run, are not embedded again (see ``embedded_once``)."""
    n = embedded_once(texts, text, path, embed)
    wanted = texts.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("key"))
    return texts.sparkSession.read.schema(_CACHED).parquet(path).join(wanted, "key", "left_semi"), n


def image_relevance(articles: DataFrame, images: DataFrame, least: float = 0.20) -> DataFrame:
    """(article_id, image_id, score, relevant, rank, best) of images (article_id, image_id, embedding) under the text of their article
    (article_id, embedding): cosines in Arrow batches, ranked by score, then id; best is the first if it is relevant.

    Images without an article, or with a null vector on either side, have no score: they come last and are not relevant."""

    @F.pandas_udf("double")
    def cosines(a: pd.Series, b: pd.Series) -> pd.Series:
        good = a.notna() & b.notna()
        out = pd.Series(np.nan, a.index)
        if good.any():
            x, y = _matrix(a[good]), _matrix(b[good])
            out[good] = (x * y).sum(1)
        return out

    both = images.select("article_id", "image_id", F.col("embedding").cast("array<double>").alias("_image")).join(articles.select("article_id", F.col("embedding").cast("array<double>").alias("_text")), "article_id", "left")
    score = F.nanvl(cosines("_text", "_image"), F.lit(None).cast("double"))
    rows = both.select("article_id", "image_id", F.round(score, 6).alias("score"))
    order = Window.partitionBy("article_id").orderBy(F.col("score").desc_nulls_last(), F.col("image_id"))
    rows = rows.withColumn("relevant", F.coalesce(F.col("score") >= least, F.lit(False))).withColumn("rank", F.row_number().over(order))
    return rows.withColumn("best", (F.col("rank") == 1) & F.col("relevant"))


def collection_info(vectors: DataFrame) -> DataFrame:
    """One row: vectors, distinct ids, rows without a vector, least and largest dimension, and whether the collection is sound."""
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    found = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("id").alias("ids"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.min(size).alias("least"), F.max(size).alias("largest"))
    return found.withColumn("sound", (F.col("vectors") == F.col("ids")) & (F.col("missing") == 0) & F.coalesce(F.col("least") == F.col("largest"), F.lit(True)))


def checked(vectors: DataFrame, dimension: int) -> DataFrame:
    """vectors; a vector of another dimension, or none, ends the query with an error that says so."""
    found = F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("string"))
    message = F.concat(F.lit(f"expected {dimension} dimensions, found "), F.coalesce(found, F.lit("none")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(message)))


def emptied(vectors: DataFrame) -> DataFrame:
    """A collection of the same columns without rows."""
    return vectors.filter(F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class Lists:
    """Unit vectors in lists by their nearest centre; centres are means of a bounded sample, and decide the work, never the result.

    A list knows its radius, the largest distance of a row to the centre. As distances obey the triangle inequality, a vector at
    distance d from a centre is d less the radius away from the list's rows at least."""

    def __init__(self, vectors: DataFrame, capacity: int, sample: int = SAMPLE, most: int = MOST_LISTS) -> None:
        rows = vectors.filter("embedding is not null and size(embedding) > 0").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        self.rows = stored(rows, "vectors")
        n = self.rows.count()
        some = self.rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, max(n, 1))).toArrow()
        v = _matrix(pd.Series(some["embedding"].to_pylist()))
        self.centres = centres = _means(v, max(1, min(most, -(-n // capacity), max(1, len(v) // 4))))

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                d = _distances(_matrix(b["embedding"]), centres)
                at = d.argmin(1)
                yield pd.DataFrame({"id": b["id"], "embedding": b["embedding"], "list": at, "off": d[np.arange(len(d)), at]})

        listed = stored(self.rows.mapInPandas(placed, "id long, embedding array<double>, list int, off double"), "listed")
        told = {r["list"]: r for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("off")).collect()}
        self.radius = np.array([told[k]["off"] if k in told else -np.inf for k in range(len(centres))])
        #: A list of more rows than the capacity has so many stripes; rows are dealt by their hash.
        self.stripes = [max(1, -(-told[k]["n"] // capacity)) if k in told else 0 for k in range(len(centres))]
        stripes = F.array(*[F.lit(max(1, x)) for x in self.stripes])
        self.listed = listed.withColumn("stripe", F.pmod(F.xxhash64("id", "embedding"), F.element_at(stripes, F.col("list") + 1)).cast("int"))

    @property
    def apart(self) -> Callable[[np.ndarray], np.ndarray]:
        """Least distances of vectors to the rows of each list, a little less for rounding; infinite for empty lists."""
        centres, radius = self.centres, self.radius
        if np.isinf(radius).all():
            return lambda v: np.full((len(v), len(radius)), np.inf)
        return lambda v: np.where(np.isinf(radius), np.inf, np.maximum(_distances(v, centres) - radius - 1e-6, 0.0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0.0))


def _means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample, from evenly spaced rows."""
    if not len(v):
        return np.zeros((1, 1))
    centres = v[np.linspace(0, len(v) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 0):
        at = _distances(v, centres).argmin(1)
        for j in np.unique(at):
            centres[j] = v[at == j].mean(0)
    return centres


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Runs of equal keys in sorted batches, and whether a run begins a new key."""
    last = None
    for b in batches:
        if b.empty:
            continue
        k = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(b)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            own = tuple(k[a])
            yield own != last, b.iloc[a:z]
            last = own


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches, HELD at a time."""
    for b in batches:
        for at in range(0, len(b), HELD):
            yield b.iloc[at : at + HELD]


def similar_pairs(vectors: DataFrame, least: float = 0.70, tile: int = TILE) -> DataFrame:
    """(a, b, similarity), a < b: all pairs at or above least, exact.

    Tiles are stripes of lists (see Lists). Each pair of tiles meets in one of the two, in turn, so each takes its share; a row is
    sent only to tiles whose list can hold a partner by the triangle inequality. A task holds its tile and streams the visitors."""
    lists = Lists(vectors, tile)
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    first, apart = np.cumsum([0, *lists.stripes]), lists.apart
    total, of = int(first[-1]), np.repeat(np.arange(len(lists.stripes)), lists.stripes)
    known = lists.listed

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.arange(total)
        for b in _slices(batches):
            v = _matrix(b["embedding"])
            unit = np.linalg.norm(v, axis=1) > 0
            own = first[b["list"].to_numpy()] + b["stripe"].to_numpy()
            near = (apart(v)[:, of] <= reach) | (least <= 0) | ~unit[:, None]
            # of two tiles the lower one holds if their sum is even, else the upper one
            host = np.where((own[:, None] + every[None]) % 2 == 0, every[None] < own[:, None], every[None] > own[:, None])
            row, at = np.nonzero(near & host)
            yield pd.DataFrame({"tile": own, "kind": 0, "id": b["id"].to_numpy(), "embedding": b["embedding"].to_numpy()})
            for k in range(0, len(row), 8 * HELD):  # a row goes to many tiles
                some = row[k : k + 8 * HELD]
                yield pd.DataFrame({"tile": at[k : k + 8 * HELD], "kind": 1, "id": b["id"].to_numpy()[some], "embedding": b["embedding"].to_numpy()[some]})

    met = known.mapInPandas(sent, "tile int, kind int, id long, embedding array<double>").repartition("tile").sortWithinPartitions("tile", "kind")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple[np.ndarray, np.ndarray]] = []
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "similarity": np.empty(0)})
        out, held = [none], 0
        for new, run in _groups(batches, ["tile", "kind"]):
            inside = run["kind"].iloc[0] == 0
            if new and inside:
                own = []
            ids, x = run["id"].to_numpy(), _matrix(run["embedding"])
            for at in range(0, len(x), HELD):
                some = slice(at, at + HELD)
                if inside:  # with what of the tile came before
                    own.append((ids[some], x[some]))
                for others, y in own:
                    s = x[some] @ y.T
                    i, j = np.nonzero(s >= least - 1e-12)
                    a, b = ids[some][i], others[j]
                    keep = a != b
                    if inside and others is own[-1][0]:
                        keep &= i > j
                    out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[i, j][keep]}))
                    held += len(out[-1])
                    if held >= PAIRS:
                        yield pd.concat(out)
                        out, held = [none], 0
            if len(out) >= HELD:
                out = [pd.concat(out)]
        yield pd.concat(out)

    return met.mapInPandas(compared, "a long, b long, similarity double")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 3, own: bool = True, probes: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(query_id, id, similarity, place): the k nearest by cosine, ties by id; own=False leaves a query's own id out.

    Queries are a table; a query asks its nearest list first, which gives it the similarity that its k-th hit has at least, and then
    all lists that can hold as near a row: exact. With probes it asks only so many of its nearest lists: approximate. A task holds
    QUERIES queries at most and streams the rows of a stripe of a list; the plan is the same for any number of queries."""
    lists = Lists(vectors, capacity)
    wanted = stored(queries.filter("embedding is not null and size(embedding) > 0").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), "queries")

    measured = lists.apart

    def asked(phase: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _slices(batches):
                v = _matrix(b["embedding"])
                apart = measured(v)
                order = np.argsort(apart, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(order.shape[1])[None], axis=1)
                able = ~np.isinf(apart)
                if phase == 0:
                    able &= rank < (probes or 1)
                else:
                    # cos >= s means a distance of sqrt(2 - 2s) at most between unit vectors; zero vectors ask everywhere
                    far = np.sqrt(np.maximum(2 - 2 * np.nan_to_num(b["least"].to_numpy(np.float64), nan=-1.0), 0.0)) + 1e-6
                    zero = np.linalg.norm(v, axis=1) == 0
                    able &= (rank >= 1) & ((apart <= far[:, None]) | zero[:, None] | (b["least"].isna().to_numpy() | (b["least"].to_numpy(np.float64) <= 0))[:, None])
                row, at = np.nonzero(able)
                for j in range(0, len(row), 8 * HELD):  # a question goes to many lists
                    some = row[j : j + 8 * HELD]
                    yield pd.DataFrame({"id": b["id"].to_numpy()[some], "embedding": b["embedding"].to_numpy()[some], "list": at[j : j + 8 * HELD]})

        return ask

    def search(rows: DataFrame, phase: int) -> DataFrame:
        asking = rows.mapInPandas(asked(phase), "id long, embedding array<double>, list int")
        asking = stored(asking, "asking")
        counts = {r["list"]: r["n"] for r in asking.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = F.array(*[F.lit(-(-counts.get(j, 0) // QUERIES)) for j in range(len(lists.stripes))])
        count = F.element_at(blocks, F.col("list") + 1)
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        stripes = F.element_at(F.array(*[F.lit(max(1, x)) for x in lists.stripes]), F.col("list") + 1)
        a = asking.select(F.lit(0).alias("kind"), "list", every(stripes).alias("stripe"), F.pmod(F.xxhash64("id", "embedding"), count).cast("int").alias("block"), "id", "embedding")
        b = lists.listed.filter(count > 0).select(F.lit(1).alias("kind"), "list", "stripe", every(count).alias("block"), "id", "embedding")
        keys = ["list", "stripe", "block"]
        met = a.unionAll(b).repartition(*keys).sortWithinPartitions(*keys, "kind")

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, best = np.empty(0, np.int64), np.empty((0, 1)), []

            def found() -> pd.DataFrame:
                return pd.DataFrame({"query_id": np.repeat(ids, [len(x) for x, _ in best]), "id": np.concatenate([x for _, x in best]).astype(np.int64), "similarity": np.concatenate([x for x, _ in best])})

            waiting: list[pd.DataFrame] = []
            for new, run in _groups(_slices(batches), keys):
                if new and best:
                    yield found()
                if new:
                    waiting, best = [], []
                if (asks := run[run["kind"] == 0]).size:
                    waiting.append(asks)
                rows_ = run[run["kind"] == 1]
                if rows_.empty or not waiting:
                    continue
                if not best:
                    whole = pd.concat(waiting)
                    ids, q = whole["id"].to_numpy(), _matrix(whole["embedding"])
                    best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
                    least = np.full(len(ids), -np.inf)  # what a hit has to reach
                at_, s = rows_["id"].to_numpy(), np.round(_matrix(rows_["embedding"]) @ q.T, 9)
                for j in np.flatnonzero(~(s < least).all(0)).tolist():
                    near, at = s[:, j], at_
                    if not own:
                        near, at = near[at != ids[j]], at[at != ids[j]]
                    if len(best[j][0]) == k:
                        good = near >= best[j][0][-1]
                        near, at = near[good], at[good]
                    if len(near) > k:
                        good = near >= np.partition(near, -k)[-k]
                        near, at = near[good], at[good]
                    if len(near):
                        near, at = np.concatenate([best[j][0], near]), np.concatenate([best[j][1], at])
                        order = np.lexsort((at, -near))[:k]
                        best[j] = near[order], at[order]
                        if len(order) == k:
                            least[j] = best[j][0][-1]
            if best:
                yield found()

        return met.mapInPandas(nearest, "query_id long, id long, similarity double")

    hits = stored(search(wanted, 0), "hits")
    if probes is None and len(lists.stripes) > 1:
        told = Window.partitionBy("query_id").orderBy(F.col("similarity").desc())
        least = hits.withColumn("_n", F.row_number().over(told)).filter(F.col("_n") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("least"))
        hits = hits.unionAll(search(wanted.join(least, "id", "left"), 1))
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def merged(hits: DataFrame) -> DataFrame:
    """The best hit of each article over all variants of a query."""
    best = Window.partitionBy("query_id", "id").orderBy(F.col("similarity").desc(), F.col("variant"))
    return hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def retrieved(hits: DataFrame, k: int = 3, least: float = 0.20) -> DataFrame:
    """Hits at or above least by (similarity, article_score) descending, first k per query."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("article_score").desc(), F.col("id"))
    return merged(hits).filter(F.col("similarity") >= least).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def lexical_fallback(hits: DataFrame, stopwords: tuple[str, ...] = STOPWORDS, phrases: tuple[str, ...] = KEY_PHRASES, least: float = 0.20) -> DataFrame:
    """The candidate whose title, category and source share most with the query (columns query, title, category, source): Jaccard
    of keywords plus a tenth for each shared phrase; only at or above least, and only where keywords overlap."""
    told = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "category", "source")]))
    asked, known = F.array_distinct(T.keywords(F.col("query"), stopwords)), F.array_distinct(T.keywords(told, stopwords))
    shared = F.size(F.array_intersect(asked, known))
    bonus = sum((F.when(F.lower("query").contains(p) & F.lower("title").contains(p), 1).otherwise(0) for p in phrases), F.lit(0))
    rows = hits.withColumn("lexical", F.round(shared / F.size(F.array_union(asked, known)) + 0.1 * bonus, 6)).filter(shared > 0)
    best = Window.partitionBy("query_id").orderBy(F.col("lexical").desc(), F.col("id"))
    return rows.withColumn("_n", F.row_number().over(best)).filter((F.col("_n") == 1) & (F.col("lexical") >= least)).drop("_n")


def retrieval_metrics(places: DataFrame) -> DataFrame:
    """One row from (query_id, relevant_place or null, top_similarity or null): hit rates at 1, 3, 5, mean reciprocal rank and the
    average of the top similarities."""
    at = lambda k: F.round(F.avg(F.when(F.col("relevant_place") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    top = F.coalesce(F.round(F.avg("top_similarity"), 6), F.lit(0.0)).alias("average_similarity")
    return places.agg(F.count(F.lit(1)).alias("n"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1.0 / F.col("relevant_place"), F.lit(0.0))), 6).alias("mrr"), top)


def negative_rejection(queries: DataFrame, hits: DataFrame, least: float = 0.20) -> DataFrame:
    """One row: questions (query_id) that nothing should answer, those without a hit of at least least, and their share."""
    found = hits.filter(F.col("similarity") >= least).select("query_id").distinct().withColumn("_hit", F.lit(True))
    told = queries.select("query_id").distinct().join(found, "query_id", "left").agg(F.count(F.lit(1)).alias("negative"), F.count_if(F.col("_hit").isNull()).alias("rejected"))
    return told.withColumn("rejection_rate", F.when(F.col("negative") > 0, F.round(F.col("rejected") / F.col("negative"), 6)).otherwise(0.0))


def pipeline_metrics(results: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """One row from results (flags, n_claims, n_supported, top_similarity): how many passed each flag, claims, their support rate,
    and the average top similarity."""
    passed = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags]
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    out = results.agg(F.count(F.lit(1)).alias("total"), *passed, whole("n_claims"), whole("n_supported"), F.coalesce(F.round(F.avg("top_similarity"), 6), F.lit(0.0)).alias("average_similarity"))
    return out.withColumn("support_rate", F.when(F.col("n_claims") > 0, F.round(F.col("n_supported") / F.col("n_claims"), 6)).otherwise(0.0))
