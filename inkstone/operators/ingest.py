"""Validation, date window, funnel, insert-if-absent, link discovery, HTML extraction, migrations and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import urls as U
from inkstone.operators.ordering import numbered
from inkstone.session import stored
from inkstone.operators.score import END, START

LEAST_CONTENT = 300


def validation_errors() -> Column:
    """Errors of a row in a fixed order; a text is missing or too short, never both."""
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    tests = [F.when(missing(c), F.lit(f"missing {c}")) for c in ("title", "url", "source", "published_date")]
    content = F.when(missing("content"), F.lit("missing content")).when(F.length("content") < LEAST_CONTENT, F.lit("content too short"))
    return F.array_compact(F.array(*tests, content))


def in_window(published: Column, start: str = START, end: str = END) -> Column:
    """Both ends included; the end is its midnight. No date: false."""
    return F.coalesce(published.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), F.lit(False))


def new_rows(batch: DataFrame, known: DataFrame, key: str = "url", order: str = "id") -> DataFrame:
    """Rows of batch whose key is not known, the first of each key (by partial aggregation: a hot key is no hot task)."""
    rows = batch.join(known.select(key).distinct(), key, "left_anti").select(*batch.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*batch.columns), F.col(order)).alias("_row")).select("_row.*")


def known_rows(batch: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    return batch.join(known.select(key), key, "left_semi")


def _gated(batch: DataFrame, known: DataFrame, start: str, end: str) -> DataFrame:
    """(gate, n) by the first gate that stops a row, or saved; of one URL the first row is saved."""
    valid = F.size(validation_errors()) == 0
    rows = batch.join(known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left")
    gate = F.when(~valid, "invalid").when(~in_window(F.col("published_date"), start, end), "outside_date_range").when(F.col("_known"), "duplicate")
    each = rows.select(gate.alias("gate"), "url").groupBy("gate", F.when(F.col("gate").isNull(), F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    pair = lambda name, n: F.struct(name.alias("gate"), n.alias("n"))
    told = F.when(F.col("gate").isNull(), F.array(pair(F.lit("saved"), F.lit(1).cast("long")), pair(F.lit("duplicate"), F.col("n") - 1))).otherwise(F.array(pair(F.col("gate"), F.col("n"))))
    return each.select(F.explode(told).alias("x")).groupBy("x.gate").agg(F.sum("x.n").alias("n"))


def funnel(batch: DataFrame, known: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """(gate, n): the first gate that stops a row, or saved; gates that stop none are left out."""
    return _gated(batch, known, start, end).filter("n > 0")


#: Counters of a collection run, in their order.
COUNTERS = ("discovered", "scraped", "invalid", "outside_date_range", "duplicates", "saved", "failed")


def collection_stats(batch: DataFrame, known: DataFrame, scraped: Column, start: str = START, end: str = END) -> DataFrame:
    """(counter, n) for all counters: every row is discovered; those that are not scraped have failed, the others go through the gates."""
    rows = batch.withColumn("_scraped", F.coalesce(scraped, F.lit(False)))
    first = rows.agg(F.count(F.lit(1)).alias("discovered"), F.count_if("_scraped").alias("scraped"), F.count_if(~F.col("_scraped")).alias("failed"))
    first = first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in first.columns])).alias("x")).select("x.*")
    gates = _gated(rows.filter("_scraped").drop("_scraped"), known, start, end)
    gates = gates.select(F.when(F.col("gate") == "duplicate", "duplicates").otherwise(F.col("gate")).alias("counter"), "n")
    names = batch.sparkSession.createDataFrame([(c,) for c in COUNTERS], "counter string")
    return names.join(first.unionAll(gates), "counter", "left").select("counter", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


class _Lenient(HTMLParser):
    """Takes unknown marked sections (``<![foo[``) as comments instead of failing on them."""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


class _Links(_Lenient):
    """Targets of the anchors of a page, entities decoded; comments and scripts have none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := (next((v for k, v in attrs if k == "href"), None) or "").strip()):
            self.found.append(href)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, href) of every anchor with a target, quoted or not."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hrefs = [], []
            for k, html in enumerate(b.column(2)):
                page = _Links()
                page.feed(html.as_py() or "")
                page.close()
                rows += [k] * len(page.found)
                hrefs += page.found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(hrefs, pa.string())], names=["page_id", "url", "href"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(made, "page_id long, url string, href string")


def discovered(pages: DataFrame) -> DataFrame:
    """(page_id, link): distinct article links of a page's own host, without query and fragment."""
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rows = anchors(pages).select("page_id", base.alias("base"), F.regexp_replace("url", r"[?#].*$", "").alias("self"), F.col("href").alias("h"))
    h = F.col("h")
    absolute = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract("base", "^([^:]*:)", 1), h)).when(h.startswith("/"), F.concat("base", h))
        .when(h.startswith("#"), F.col("self")).otherwise(F.concat(F.regexp_replace("self", r"(://[^/]*/(?:.*/)?)[^/]*$", "$1"), h))
    )
    rows = rows.select("page_id", "base", F.regexp_replace(absolute, r"[?#].*$", "").alias("link"))
    return rows.filter((U.host(F.col("link")) == U.host(F.col("base"))) & U.is_article(F.col("link"))).select("page_id", "link").distinct()


class _Article(_Lenient):
    """First h1, author, date and paragraphs of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = self.author = self.date = None
        self.inside, self.all, self.images = [], [], []
        self._open: list[str] = []
        self._text: list[str] | None = None
        self._what = ""
        self._article = 0
        self._json: list[str] | None = None
        self.json: list[str] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "article":
            self._article += 1
        if tag in ("h1", "p"):
            self._close()
            if tag == "p" or self.title is None:
                self._text, self._what = [], tag
        if tag == "script" and a.get("type") == "application/ld+json":
            self._json = []
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name, a.get("content") or "")
        if tag == "img" and self._article:
            last = (a.get("srcset") or "").split(",")[-1].strip().split(" ")[0]
            self.images.append(next((x for x in (a.get("src"), a.get("data-src"), a.get("data-lazy-src"), a.get("data-original"), last) if x), ""))
        self.date = self.date or a.get("datetime") or a.get("data-date")
        if "author" in (a.get("class") or "") and self.author is None:
            self.author = a.get("title") or a.get("data-author")

    def handle_endtag(self, tag: str) -> None:
        if tag == self._what or tag in ("article", "body"):
            self._close()
        if tag == "article":
            self._article = max(0, self._article - 1)
        if tag == "script" and self._json is not None:
            self.json.append("".join(self._json))
            self._json = None

    def handle_data(self, data: str) -> None:
        if self._json is not None:
            self._json.append(data)
        elif self._text is not None and self.cdata_elem is None:
            self._text.append(data)

    def _close(self) -> None:
        if self._text is not None:
            text = " ".join("".join(self._text).split())
            if self._what == "h1":
                self.title = self.title or text
            elif text:
                self.all.append(text)
                if self._article:
                    self.inside.append(text)
        self._text, self._what = None, ""


def parsed_page(html: str | None) -> _Article:
    page = _Article()
    page.feed(html or "")
    page.close()
    page._close()
    return page


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, author, published, content, found): found is false without a title or a text."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [parsed_page(h) for h in b["html"]]
            texts = ["\n".join(p.inside or p.all) for p in read]
            yield pd.DataFrame({
                "page_id": b["page_id"], "url": b["url"], "title": [p.title for p in read], "author": [p.author for p in read], "published": [p.date for p in read],
                "content": texts, "found": [bool(p.title) and bool(t) for p, t in zip(read, texts, strict=True)],
            })

    schema = "page_id long, url string, title string, author string, published string, content string, found boolean"
    return pages.select("page_id", "url", "html").mapInPandas(made, schema)


#: Columns that later versions of the articles table have added.
ADDED = {
    **dict.fromkeys(("relevance_score", "northeast_score", "security_score", "development_score", "society_score", "sports_score"), "int"), "category": "string",
    **dict.fromkeys(("article_score", "theme_score", "security_relevance_score", "freshness_score", "source_quality_score", "content_quality_score", "rank"), "int"),
}


def migrated(articles: DataFrame) -> DataFrame:
    """articles with the columns of ADDED that it lacks (zero for scores, null for category and rank)."""
    zero = lambda c, t: F.lit(0 if t == "int" and c != "rank" else None).cast(t)
    return articles.withColumns({c: zero(c, t) for c, t in ADDED.items() if c not in articles.columns})


def without_title(articles: DataFrame, title: str = "Test Article") -> DataFrame:
    """Delete by predicate; rows without a title stay."""
    return articles.filter(~F.coalesce(F.col("title") == title, F.lit(False)))


def relevant(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("category").isNotNull() & (F.col("category") != "Not Relevant"))


def category_scan(articles: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Articles of these categories, with position by score (descending) and id."""
    rows = stored(articles.filter(F.col("category").isin(*categories)), "scanned")  # numbering reads twice
    return numbered(rows, [F.col("article_score").desc(), F.col("id").asc()], "position")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; of one key the row of new, and of several the last by its seq column."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col("_from").desc(), F.col("seq").desc())
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_from")


MIME, MOST_BYTES, LEAST_WIDTH, LEAST_HEIGHT = ("image/jpeg", "image/jpg", "image/png", "image/webp"), 10 << 20, 300, 200


def accepted_images(images: DataFrame, most: int) -> DataFrame:
    """The first most images per article (by position) of an accepted kind and size, distinct by URL, named by content hash."""
    fit = F.lower(F.trim(F.substring_index("mime", ";", 1))).isin(*MIME) & (F.octet_length("payload") <= MOST_BYTES) & (F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT)
    rows = images.filter(fit).withColumn("name", F.sha2("payload", 256))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("article_id", "image_url").orderBy("position"))).filter("_n = 1")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("article_id").orderBy("position"))).filter(F.col("_n") <= most).drop("_n")
