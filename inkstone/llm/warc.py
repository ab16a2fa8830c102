"""Not-modified revisits resolved by an as-of join to the latest earlier full response.

Records of one canonical URL are ordered by time (ties by record id). A revisit takes the last
full response before it; validators then decide: entity tags by weak comparison, else the
last-modified dates, else payload digests, whichever both sides have. A resolved record has the
response's body reference and headers, updated by the headers that a not-modified answer may
carry (UPDATES).

The join is a forward fill after a range partitioning by (URL, time, id), so that captures of
one hot URL spread over many tasks; what a partition leaves to the next ones is one record,
and the driver sees one row per partition.

Defined cases: a null URL never matches (outcome no_url); a revisit without an earlier full
response is no_response; with one, but no validator in common, no_validator; with unequal ones,
mismatch; repeated rows are each resolved; header names are compared in lower case; an empty
table gives an empty result; bodies are not moved, only the id of their record; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import stored
from inkstone.session import ship

#: Header fields of a 304 answer that update the stored response.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another resource.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without final slashes, sorted query without tracking; no scheme or fragment."""
    host = F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike(_SCHEME), F.concat(host, path, query)).otherwise(url)


def _lower_names(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    # of names that differ in case only, the last stands
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    latest = F.filter(lower, lambda e, i: ~F.exists(F.slice(lower, i + 2, F.greatest(F.size(lower), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(latest)


RECORD = "record_id long, url string, ts long, revisit boolean, digest string, headers map<string,string>"


def resolved(records: DataFrame) -> DataFrame:
    """The revisits of records (columns of RECORD) with canonical_url, source_id, outcome and merged headers."""
    spark = records.sparkSession
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"),
        F.coalesce(F.col("revisit"), F.lit(False)).alias("revisit"), F.col("digest").cast("string").alias("digest"), _lower_names(F.col("headers")).alias("headers"),
    )
    rows = rows.select("record_id", "canonical_url", "ts", "revisit", F.struct("record_id", "digest", F.map_entries("headers").alias("headers")).alias("held"))
    order = ["canonical_url", "ts", "record_id", "revisit"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = spread.schema["held"].dataType.simpleString()
    schema = f"part int, record_id long, canonical_url string, ts long, revisit boolean, held {kind}, source {kind}"

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Revisits with the last response of their URL in this partition; at its end, the partition's last response as a row of its own."""
        part, url, last, url_seen = TaskContext.get().partitionId(), None, None, False
        for b in batches:
            held = b.column(4)
            sources, kept = [], []
            for i, (u, revisit) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if not url_seen or u != url:
                    url, last, url_seen = u, None, True
                if revisit:
                    kept.append(i)
                    sources.append(last if u is not None else None)
                else:
                    last = held[i].as_py()
            take = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(kept), pa.int32()), *take.columns, pa.array(sources, held.type)], names=["part", *b.schema.names, "source"])
            held_type = held.type
        if url_seen and url is not None and last is not None:
            end = [[part], [None], [url], [None], [None], [None], [last]]
            types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), held_type, held_type]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(end, types, strict=True)], names=["part", "record_id", "canonical_url", "ts", "revisit", "held", "source"])

    local = stored(spread.mapInArrow(filled, schema), "filled")
    # the last response before each partition, if its URL goes on there: later partitions of the same URL may have none of their own
    ends = {r["part"]: (r["canonical_url"], r["source"]) for r in local.filter("revisit is null").select("part", "canonical_url", "source").collect()}
    carried, now = [], None
    most = local.agg(F.max("part")).first()[0]
    for part in range((most if most is not None else -1) + 1):
        if now is not None:
            carried.append((part, *now))
        now = ends.get(part, now)  # one of another URL is left unused: no row of that URL follows
    carry = spark.createDataFrame(carried, f"part int, canonical_url string, carried {kind}")
    out = local.filter("revisit is not null").join(carry, ["part", "canonical_url"], "left").withColumn("source", F.coalesce("source", "carried"))
    return out.select("record_id", "canonical_url", "ts", F.col("source.record_id").alias("source_id"), *_merged())


def _merged() -> list[Column]:
    own, old = F.map_from_entries("held.headers"), F.map_from_entries("source.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    checks = [(tag(own), tag(old)), (own["last-modified"], old["last-modified"]), (F.col("held.digest"), F.col("source.digest"))]
    equal = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in checks])
    outcome = (
        F.when(F.col("canonical_url").isNull(), "no_url").when(F.col("source").isNull(), "no_response").when(equal.isNull(), "no_validator").when(equal, "resolved").otherwise("mismatch")
    )
    news = F.map_filter(own, lambda k, _: k.isin(*UPDATES))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(news), k))
    return [outcome.alias("outcome"), F.when(F.coalesce(equal, F.lit(False)), F.map_concat(kept, news)).alias("headers")]


def with_bodies(found: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """found plus the body of each resolved record's source, by a join on the record's id."""
    bodies = records.filter(~F.coalesce(F.col("revisit"), F.lit(False))).select(F.col("record_id").cast("long").alias("source_id"), F.col(body).alias("_body")).dropDuplicates(["source_id"])
    return found.join(bodies, "source_id", "left").withColumn(body, F.when(F.col("outcome") == "resolved", F.col("_body"))).drop("_body")


#: The query's second crawl asks for each page so many seconds after its first.
LATER = 1000


def crawl(pages: DataFrame) -> DataFrame:
    """Two records per page: its full response at second page_id, and a not-modified answer LATER seconds on.

    Pages divisible by 5 answer without a tag but with a date, those divisible by 7 with another tag."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    etag, day = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.concat(F.lit("day "), (F.col("page_id") % 10).cast("string"))
    pair = lambda k, v: (F.lit(k), v)
    first = F.create_map(*pair("Content-Type", F.lit("text/html")), *pair("Content-Length", size), *pair("ETag", etag), *pair("Last-Modified", day), *pair("Date", F.col("page_id").cast("string")))
    later = (F.col("page_id") + LATER).cast("string")
    told = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).when(F.col("page_id") % 5 != 0, F.concat(F.lit("W/"), etag))
    again = F.create_map(*pair("etag", told), *pair("last-modified", day), *pair("date", later), *pair("content-length", F.lit("0")))
    none = F.lit(None).cast("string").alias("digest")
    return pages.select((2 * F.col("page_id")).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit(False).alias("revisit"), none, first.alias("headers")).unionAll(
        pages.select((2 * F.col("page_id") + 1).alias("record_id"), "url", (F.col("page_id") + LATER).alias("ts"), F.lit(True).alias("revisit"), none, again.alias("headers"))
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolved(crawl(ship(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return out.select(
        F.expr("record_id div 2").alias("page_id"), "canonical_url", F.expr("source_id div 2").alias("source_page_id"), "outcome",
        *[F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "date", "last-modified", "content-type", "content-length")],
    )


OP10_SQL = rf"""with p as (select page_id, url, html, md5(coalesce(html, '')) as h,
  lower(regexp_extract(url, '{_SCHEME}(?:[^/?#@]*@)?([^/?#]*)', 1)) as host, regexp_replace(regexp_extract(url, '{_SCHEME}[^/?#]*([^?#]*)', 1), '/+$', '') as path,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))) as q from pages),
c as (select *, case when regexp_matches(url, '{_SCHEME}') then regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || path ||
  case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end else url end as canonical_url from p),
best as (select v.page_id as page_id, max(struct_pack(ts := r.page_id, id := r.page_id)) as s from c v join c r
  on v.canonical_url = r.canonical_url and r.page_id < v.page_id + {LATER} + 1 and (r.page_id, 2 * r.page_id) < (v.page_id + {LATER}, 2 * v.page_id + 1) group by v.page_id),
j as (select v.page_id, v.canonical_url, v.h as own_h, r.page_id as source_page_id, r.h as h, r.html as html from c v left join best b on v.page_id = b.page_id left join c r on r.page_id = b.s.id),
k as (select *, case when canonical_url is null then 'no_url' when source_page_id is null then 'no_response'
  when page_id % 7 = 0 then 'mismatch' when page_id % 5 <> 0 then case when own_h = h then 'resolved' else 'mismatch' end
  when page_id % 10 = source_page_id % 10 then 'resolved' else 'mismatch' end as outcome from j)
select page_id, canonical_url, source_page_id, outcome,
  case when outcome = 'resolved' then case when page_id % 5 <> 0 then 'W/"' || own_h || '"' else '"' || h || '"' end end as etag,
  case when outcome = 'resolved' then (page_id + {LATER})::varchar end as date,
  case when outcome = 'resolved' then 'day ' || (page_id % 10)::varchar end as last_modified,
  case when outcome = 'resolved' then 'text/html' end as content_type,
  case when outcome = 'resolved' then strlen(coalesce(html, ''))::varchar end as content_length from k"""
