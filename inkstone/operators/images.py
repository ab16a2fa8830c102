"""Image candidates of pages, search phrases for articles, and the order of candidates."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import urls as U
from inkstone.operators.ingest import parsed_page

# Words for search phrases.
PHRASE_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "from", "by", "at", "as", "is", "are", "was", "were", "be", "been", "this", "that", "these", "those",
    "over", "under", "after", "before", "into", "amid", "says", "said", "worth", "nab", "two", "three", "new", "news",
)
GENERIC = (
    "assam", "northeast", "northeastern", "india", "indian", "state", "states", "district", "city", "region", "government", "centre", "central", "official", "officials", "people",
    "person", "report", "reports",
)
EVENTS = (
    "army", "assam rifles", "military", "defence", "defense", "border", "security", "heroin", "narcotics", "drug", "drugs", "trafficking", "smuggling", "operation", "operations",
    "raid", "seized", "seizure", "arrested", "arrest", "election", "bypoll", "poll", "cricket", "football", "marathon", "coffee", "farmers", "infrastructure", "railway",
    "station", "industry", "industrial", "development", "funding", "protest", "protests", "school", "students", "youth", "cattle", "garbage", "civic", "missing", "kuki",
    "manipur", "mizoram", "nagaland", "meghalaya", "tripura", "sikkim", "arunachal",
)
LOCATIONS = (
    "assam", "mizoram", "manipur", "nagaland", "meghalaya", "tripura", "sikkim", "arunachal", "arunachal pradesh", "guwahati", "nagaon", "lumding", "aizawl", "kohima", "imphal",
    "shillong", "agartala", "gangtok", "itanagar", "kangpokpi",
)
#: Kinds of candidates, best first.
KINDS = ("og:image", "twitter:image", "json-ld", "article-image")


def _by_length(words: tuple[str, ...]) -> Column:
    """Longest first, equal lengths in alphabetical order."""
    return F.array(*[F.lit(w) for w in sorted(words, key=lambda w: (-len(w), w))])


def search_phrases(title: Column, category: Column, events=EVENTS, locations=LOCATIONS, stopwords=PHRASE_STOPWORDS, generic=GENERIC) -> Column:
    """Up to four distinct phrases: events with places, title words, a news photo, a photo of the category."""
    low = F.lower(F.coalesce(title, F.lit("")))
    words = F.transform(F.regexp_extract_all(low, F.lit(r"([a-z][a-z'-]+)"), F.lit(1)), lambda w: F.trim(w, F.lit("'")))
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords) & ~w.isin(*generic)))
    found = lambda ws: F.filter(_by_length(ws), lambda w: F.contains(low, w))
    event, place = found(events), found(locations)
    joined = lambda *parts: F.array_join(F.concat(*parts), " ")
    some, kind = F.size(words) > 0, F.lower(F.coalesce(category, F.lit("")))
    phrases = F.array(
        F.when((F.size(event) > 0) & (F.size(place) > 0), joined(F.slice(event, 1, 3), F.slice(place, 1, 2))),
        F.when(some, joined(F.slice(words, 1, 7), F.slice(place, 1, 2))),
        F.when(some, joined(F.slice(words, 1, 6), F.slice(place, 1, 1), F.array(F.lit("news photo")))),
        F.when(some & (kind != ""), joined(F.slice(words, 1, 5), F.slice(place, 1, 1), F.array(F.concat(kind, F.lit(" photo"))))),
    )
    return F.slice(F.array_distinct(F.array_compact(phrases)), 1, 4)


def _linked_images(value) -> list[str]:
    """Image addresses anywhere in a JSON-LD document, in order."""
    if isinstance(value, list):
        return [x for v in value for x in _linked_images(v)]
    if not isinstance(value, dict):
        return []
    image = value.get("image")
    own = [x if isinstance(x, str) else x.get("url") for x in (image if isinstance(image, list) else [image]) if isinstance(x, str | dict)]
    return [x for x in own if isinstance(x, str)] + [x for k, v in value.items() if k != "image" for x in _linked_images(v)]


def page_images(url: str, html: str | None) -> list[tuple[str, str]]:
    """(kind, absolute address) of all candidates of a page, in order."""
    page = parsed_page(html)
    found = [(k, page.meta[k]) for k in KINDS[:2] if page.meta.get(k)]
    for text in page.json:
        try:
            found += [("json-ld", x) for x in _linked_images(json.loads(text))]
        except ValueError:
            continue
    found += [("article-image", x) for x in page.images if x]
    return [(k, urljoin(url, x.strip())) for k, x in found]


def candidates(pages: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, place, kind, image_url): a page's own editorial images, one of each identity, best kinds first."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, u, n, k, x) for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) if u for n, (k, x) in enumerate(page_images(u, h))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "n", "kind", "image"])

    rows = pages.select("page_id", "url", "html").mapInPandas(listed, "page_id long, url string, n int, kind string, image string")
    rows = rows.withColumn("image_url", U.clean_image(F.col("image"))).filter(U.is_image(F.col("image_url")) & (U.domain(F.col("image_url")) == U.domain(F.col("url"))))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    first = Window.partitionBy("page_id", U.image_identity(F.col("image_url"))).orderBy(rank, "n")
    order = Window.partitionBy("page_id").orderBy(rank, "n")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= most).select("page_id", "place", "kind", "image_url")


def with_search_results(own: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """A page's own images, then search results by domain tier until there are most; tier 0 is left out."""
    rest = found.withColumn("tier", U.source_priority(F.col("image_url"))).filter((F.col("tier") > 0) & U.is_image(F.col("image_url")))
    both = own.select("page_id", F.lit(9).alias("tier"), "place", "image_url").unionByName(rest.select("page_id", "tier", "place", "image_url"))
    first = Window.partitionBy("page_id", U.image_identity(F.col("image_url"))).orderBy(F.col("tier").desc(), "place")
    order = Window.partitionBy("page_id").orderBy(F.col("tier").desc(), "place")
    both = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("position", F.row_number().over(order))
    return both.filter(F.col("position") <= most).select("page_id", "position", "image_url")
