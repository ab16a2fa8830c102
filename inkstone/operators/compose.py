"""Composition: records, chunks, layouts, sections, page plan and its checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.lexicons import CATEGORY_ORDER, REGIONAL
from inkstone.operators.ordering import numbered
from inkstone.session import stored

# Words per page part and layout.
OPENER_IMAGE, OPENER_PLAIN, CONTINUATION = 210, 280, 390
LONG, MEDIUM, PAGES, TAIL = 1050, 650, 50, 4
FRONT, ANALYTICS, BACK = ("cover", "contents", "editorial"), ("statistics", "charts"), ("sources", "selection", "method", "closing")
SUPPORT = ("region_focus", "category_focus", "timeline", "reading_list")


def normalized_record(records: DataFrame) -> DataFrame:
    """Aliases resolved, defaults filled, words counted, single source ids as lists."""
    pick = lambda *cs: T.first_filled(*[F.col(c) for c in cs if c in records.columns], F.lit(None).cast("string"))
    ids = F.coalesce(*[F.col(c) for c in ("source_ids",) if c in records.columns], *[F.array(F.col(c)) for c in ("source_id",) if c in records.columns], F.array().cast("array<int>"))
    body = T.page_text(pick("article", "content", "body"))
    return records.select(
        F.coalesce(*[F.col(c).cast("string") for c in ("article_id", "id") if c in records.columns]).alias("article_id"), F.coalesce(pick("headline", "title"), F.lit("Untitled")).alias("headline"),
        body.alias("body"), F.coalesce(pick("category"), F.lit(REGIONAL)).alias("category"), F.coalesce(pick("source"), F.lit("Unknown Source")).alias("source"), ids.alias("source_ids"),
        T.word_count(body).alias("words"),
    ).filter("article_id is not null")


def selection_reason(explicit: Column, category: Column, score: Column, security: Column) -> Column:
    """The given reason, else its parts joined; security counts from 20 on."""
    parts = F.concat_ws(
        "; ", F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit("Category: "), category)), F.when(score > 0, F.format_string("Score %d/100", F.bround(score.cast("double"), 0).cast("long"))),
        F.when(security >= 20, F.format_string("Security relevance %d/100", F.bround(security.cast("double"), 0).cast("long"))),
    )
    return F.coalesce(F.when(F.trim(explicit) != "", explicit), parts)


def layout(words: Column, has_image: Column) -> Column:
    return F.when(words >= LONG, "feature_long").when(has_image, "feature_image").when(words >= MEDIUM, "feature_medium").otherwise("standard")


def paragraphs(body: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n|\n", body) if p.strip()]


def by_words(paragraph: str, limit: int) -> list[str]:
    words = paragraph.split()
    return [" ".join(words[i : i + limit]) for i in range(0, len(words), limit)]


def packed(parts: list[str], limit: int) -> list[str]:
    """Paragraphs filled into chunks of at most limit words, in order; longer ones are split by words first."""
    chunks: list[list[str]] = []
    size = 0
    for p in (x for part in parts for x in (by_words(part, limit) if len(part.split()) > limit else [part])):
        n = len(p.split())
        if chunks and size + n <= limit:
            chunks[-1].append(p)
            size += n
        else:
            chunks.append([p])
            size = n
    return ["\n\n".join(c) for c in chunks]


def chunks_of(body: str | None, has_image: bool) -> list[str]:
    """Opener from the first paragraph, the rest packed; one paragraph alone is only packed."""
    parts = paragraphs(body or "")
    if len(parts) <= 1:
        return packed(parts, CONTINUATION)
    limit = OPENER_IMAGE if has_image else OPENER_PLAIN
    first = by_words(parts[0], limit)
    left = [" ".join(first[1:])] if len(first) > 1 else []
    return [first[0], *packed([*left, *parts[1:]], CONTINUATION)]


def chunks(articles: DataFrame) -> DataFrame:
    """(id, part, parts, role, chunk) of articles (id, content, has_image)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, body, image in zip(b["id"], b["content"], b["has_image"], strict=True):
                found = chunks_of(body, bool(image))
                out += [(i, k + 1, len(found), "continuation" if k else "opener", c) for k, c in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "part", "parts", "role", "chunk"])

    return articles.select("id", "content", "has_image").mapInPandas(cut, "id long, part int, parts int, role string, chunk string")


def section_order(category: Column) -> Column:
    """Place in the fixed order; unknown categories after it."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category), F.lit(0)).cast("int")


def sections(articles: DataFrame) -> DataFrame:
    """(number, category, n, first): fixed order, then others by their least id; numbered without gaps."""
    grouped = articles.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    place = section_order(F.col("category"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(len(CATEGORY_ORDER) + 1), "first")  # a row per category
    return grouped.withColumn("number", F.row_number().over(order)).select("number", "category", "n", "first")


def contents(articles: DataFrame) -> DataFrame:
    """The table of contents as rows (number, category, n, place, id, title): articles by id within their section."""
    articles = stored(articles.select("id", "title", "category"), "classified")  # read four times
    known = sections(articles).select("number", "category", "n")
    before = known.select("category", (F.sum("n").over(Window.orderBy("number")) - F.col("n")).alias("_before"))  # a row per category
    rows = numbered(articles.select("id", "title", "category").join(F.broadcast(known), "category"), [F.col("number").asc(), F.col("id").asc()], "_at")
    return rows.join(F.broadcast(before), "category").select("number", "category", "n", (F.col("_at") - F.col("_before")).alias("place"), "id", "title")


def selection_appendix(articles: DataFrame) -> DataFrame:
    """Numbered rows (number, id, title, category, source, article_score, security_part, reason) in the order of position."""
    reason = selection_reason(F.lit(None).cast("string"), F.col("category"), F.col("article_score"), F.col("security_part"))
    source = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "Unknown Source").otherwise(F.col("source"))
    rows = stored(articles.select("id", "title", "category", source.alias("source"), "article_score", "security_part", "position"), "selected")  # numbering reads twice
    rows = numbered(rows, [F.col("position").asc(), F.col("id").asc()], "number")
    return rows.withColumn("reason", reason).drop("position")


def composition_order(articles: DataFrame) -> DataFrame:
    """position by rank (nulls last), then by the id as text."""
    return numbered(articles, [F.col("rank").asc_nulls_last(), F.col("id").cast("string").asc()], "position")


def page_plan(articles: DataFrame, parts: DataFrame, pages: int = PAGES) -> DataFrame:
    """(page_number, kind, category, id, part): front, sections with their articles, analytics, back; cut at pages, or filled
    with support pages (in a cycle) before the last TAIL.

    articles (id, category, position); parts (id, part)."""
    spark = articles.sparkSession
    fixed = lambda block, names: spark.createDataFrame([(block, i, n) for i, n in enumerate(names)], "block int, at int, kind string")
    wide = lambda df: df.select("block", F.lit(0).alias("section"), F.lit("").alias("category"), F.lit(0).alias("position"), F.col("at").alias("part"), F.lit(None).cast("long").alias("id"), "kind")
    numbers = sections(articles).select("category", F.col("number").alias("section"))
    heads = numbers.select(F.lit(1).alias("block"), "section", "category", F.lit(0).alias("position"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("id"), F.lit("section").alias("kind"))
    bodies = articles.join(parts, "id").join(numbers, "category").select(F.lit(1).alias("block"), "section", "category", "position", "part", "id", F.lit("article").alias("kind"))
    plan = wide(fixed(0, FRONT)).unionByName(heads).unionByName(bodies).unionByName(wide(fixed(2, ANALYTICS))).unionByName(wide(fixed(3, BACK)))
    order = ["block", "section", "position", "part"]
    # only the first pages matter: a limit by order, then numbers over at most that many rows
    first = plan.orderBy(*order).limit(pages)
    n = first.count()
    first = first.withColumn("page_number", F.row_number().over(Window.orderBy(*order)))
    if n >= pages:
        return first.select("page_number", "kind", "category", "id", "part")
    gap, keep = pages - n, n - TAIL
    moved = first.withColumn("page_number", F.when(F.col("page_number") > keep, F.col("page_number") + gap).otherwise(F.col("page_number")))
    more = spark.createDataFrame([(keep + 1 + i, SUPPORT[i % len(SUPPORT)], "", None, i // len(SUPPORT)) for i in range(gap)], "page_number int, kind string, category string, id long, part int")
    return moved.select("page_number", "kind", "category", "id", "part").unionByName(more)


def plan_check(plan: DataFrame, pages: int = PAGES) -> DataFrame:
    """One row: page and article-page counts, pages without a kind, repeated numbers, and whether the plan holds."""
    found = plan.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("kind") == "article").alias("article_pages"), F.count_if(F.col("kind").isNull()).alias("untyped"),
        (F.count("page_number") - F.countDistinct("page_number")).alias("repeated"),
    )
    return found.withColumn("valid", (F.col("pages") == pages) & (F.col("untyped") == 0) & (F.col("repeated") == 0))


#: Parts of a composed edition, and how a page of its HTML begins; fixed values.
EDITION_KEYS = ("metadata", "toc", "sections", "charts", "articles", "page_plan", "validation")
HTML_PAGE = '<section class="magazine-page'


def edition_checks(editions: DataFrame, pages: int = PAGES) -> DataFrame:
    """(edition, problem, html_pages, valid) of composed editions (edition, body, html): body is the edition's JSON object.

    problem is the first of: no JSON object, missing keys, articles or page_plan no list, another number of planned pages than asked
    for, no articles; null if there is none. valid: no problem, and the HTML has as many pages. A null body is no JSON object, a
    null html has no pages."""
    parts = F.from_json("body", "articles array<string>, page_plan array<string>")
    rows = editions.select("edition", F.json_object_keys("body").alias("_keys"), parts.alias("_p"), F.regexp_count(F.coalesce("html", F.lit("")), F.lit(HTML_PAGE)).cast("long").alias("html_pages"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, EDITION_KEYS)), "_keys"))
    rows = rows.withColumn("_missing", missing).withColumn("_n", F.coalesce(F.size("_p.page_plan"), F.lit(0)))
    problem = (
        F.when(F.col("_keys").isNull(), "no JSON object").when(F.size("_missing") > 0, F.concat(F.lit("missing keys: "), F.array_join("_missing", ", ")))
        .when(F.col("_p.articles").isNull(), "articles is no list").when(F.col("_p.page_plan").isNull(), "page_plan is no list")
        .when(F.col("_n") != pages, F.concat(F.lit(f"expected {pages} pages, found "), F.col("_n").cast("string"))).when(F.size("_p.articles") == 0, "no articles")
    )
    return rows.select("edition", problem.alias("problem"), "html_pages").withColumn("valid", F.col("problem").isNull() & (F.col("html_pages") == pages))


def plan_offenders(plan: DataFrame, most_words: int = CONTINUATION) -> DataFrame:
    """(page_number, problem) of pages (page_number, kind, id, part, words) without a kind, with a repeated number, or with a part
    that is empty or too long."""
    problem = F.when(F.col("kind").isNull(), "no kind").when(F.count(F.lit(1)).over(Window.partitionBy("page_number")) > 1, "repeated number")
    problem = problem.when((F.col("kind") == "article") & (F.coalesce("words", F.lit(0)) == 0), "empty part").when(F.col("words") > most_words, "part too long")
    return plan.select("page_number", problem.alias("problem")).filter("problem is not null")


def page_lookup(plan: DataFrame, articles: DataFrame) -> DataFrame:
    """Article pages with the headline of their article; unresolved is true where there is none (of one id the last row counts)."""
    last = articles.groupBy("id").agg(F.max_by("title", "seq").alias("headline"))
    return plan.filter("kind = 'article'").join(last, "id", "left").withColumn("unresolved", F.col("headline").isNull())


def assets(articles: DataFrame, files: DataFrame) -> DataFrame:
    """(id, asset): an article's first file by name, or null."""
    first = files.groupBy("id").agg(F.min("path").alias("asset"))
    return articles.select("id").join(first, "id", "left")


def text_checks(pages: DataFrame, markers: tuple[str, ...], least: int = 10) -> DataFrame:
    """(check, passed): page texts long enough, and each marker somewhere (pages: page_number, text)."""
    short = F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) < least)
    found = pages.agg(short.alias("short"), *[F.max(F.coalesce(F.col("text").contains(m), F.lit(False))).alias(f"m{k}") for k, m in enumerate(markers)])
    rows = [F.struct(F.lit("page_text").alias("check"), (F.col("short") == 0).alias("passed")), *[F.struct(F.lit(f"marker {m}").alias("check"), F.coalesce(f"m{k}", F.lit(False)).alias("passed")) for k, m in enumerate(markers)]]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: What the last text check looks for in an edition; fixed values.
MARKERS = ("Securing the Northeast", "Indian Army", "The Assam Tribune", "End of Edition")


def text_findings(pages: DataFrame, markers: tuple[str, ...] = MARKERS, expected: int = PAGES, least: int = 10) -> DataFrame:
    """(severity, check, page_number, detail) of what is wrong with an edition's pages (page_number, text, failure).

    Errors: another number of pages than expected, pages whose text could not be read (failure says why), no readable page at
    all. Warnings: readable pages with fewer than least characters (runs of whitespace count as one), and markers that no readable
    page has. A null text is an empty one. Findings of the whole edition have no page_number."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    rows = pages.select(F.col("page_number").cast("long"), "failure", plain.alias("_plain"))
    finding = lambda severity, check, detail: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    own = F.when(F.col("failure").isNotNull(), finding("error", "unreadable", F.col("failure"))).when(F.length("_plain") < least, finding("warning", "little text", F.concat(F.length("_plain").cast("string"), F.lit(" characters"))))
    of_pages = rows.select("page_number", own.alias("_f")).filter("_f is not null").select("_f.severity", "_f.check", "page_number", "_f.detail")
    readable = F.col("failure").isNull()
    found = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_if(readable).alias("_readable"), *[F.coalesce(F.bool_or(readable & F.col("_plain").contains(m)), F.lit(False)).alias(f"_m{k}") for k, m in enumerate(markers)])
    whole = [
        F.when(F.col("_n") != expected, finding("error", "page count", F.concat(F.lit(f"expected {expected}, found "), F.col("_n").cast("string")))),
        F.when(F.col("_readable") == 0, finding("error", "no readable page", F.lit(None))),
        *[F.when(~F.col(f"_m{k}"), finding("warning", "marker", F.lit(m))) for k, m in enumerate(markers)],
    ]
    of_edition = found.select(F.explode(F.array_compact(F.array(*whole))).alias("_f")).select("_f.severity", "_f.check", F.lit(None).cast("long").alias("page_number"), "_f.detail")
    return of_pages.unionAll(of_edition)


def accepted(findings: DataFrame) -> DataFrame:
    """One row (errors, warnings, passed): warnings alone do not fail an edition."""
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.withColumn("passed", F.col("errors") == 0)
