"""Relevance, themes and editorial categories from weighted lexicons, as one chain of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.lexicons import CATEGORY_ORDER, DEVELOPMENT, NOT_RELEVANT, REGIONAL, SECURITY, SOCIETY, SPORTS, THEMES, Lexicons

#: Column names of the raw theme scores, in the order of THEMES.
RAW = ("security_score", "development_score", "society_score", "sports_score")


def vocabulary(lexicons: Lexicons) -> tuple[str, ...]:
    """All words that any rule looks for, those of phrases too."""
    named = [lexicons.states, lexicons.entities, lexicons.region, *lexicons.themes.values(), lexicons.irrelevant, *lexicons.boosts.values(), lexicons.generic_terms, *lexicons.titles.values()]
    return T.words_of(t for terms in named for x in terms for t in (x, x.replace("-", " ")))


def prepared(articles: DataFrame, lexicons: Lexicons) -> DataFrame:
    """articles with lower-case texts, as they are (_low) and normalised, and those of their words that are in a lexicon, each computed once.

    Rules read the texts as they are: squeezing the white space of every text takes longer than looking for the few phrases."""
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    known = vocabulary(lexicons)
    return (
        articles.withColumn("_title", T.normalized(title))
        .withColumn("_content", T.normalized(content))
        .withColumn("_all", F.trim(F.concat_ws(" ", "_title", "_title", "_content")))
        .withColumns({"_low_title": F.lower(title), "_low_content": F.lower(content)})
        .withColumn("_low_all", F.concat_ws(" ", "_low_title", "_low_title", "_low_content"))
        .withColumn("_title_words", T.tokens(F.col("_low_title"), known))
        .withColumn("_content_words", T.tokens(F.col("_low_content"), known))
        .withColumn("_all_words", F.array_union("_title_words", "_content_words"))
        .withColumn("_plain_title", T.normalized_hyphens(title))
        .withColumn("_plain_words", T.tokens(F.col("_plain_title"), known))
    )


def lexicon_scores(rows: DataFrame, lexicons: Lexicons) -> DataFrame:
    """Region score, region terms, raw theme scores on title and content together, irrelevant score, title matches."""
    def found(lexicon: dict[str, int], where: str) -> Column:
        return T.matched_terms(F.col(f"_low_{where}"), F.col(f"_{where}_words"), list(lexicon))

    parts = (lexicons.states, lexicons.entities, lexicons.region)
    region = sum((T.weighted(found(p, "all"), p) for p in parts), F.lit(0))
    in_title = [found(p, "title") for p in parts]
    title_score = sum((T.weighted(t, p, 2) for t, p in zip(in_title, parts, strict=True)), F.lit(0))
    out = rows.withColumn("_region_terms", F.array_distinct(F.concat(*[found(p, "all") for p in parts]))).withColumn("_title_region", F.size(F.concat(*in_title)) > 0)
    out = out.withColumn("region_score", F.least(F.lit(100), region + title_score))
    out = out.withColumns({name: T.weighted(found(lexicons.themes[t], "all"), lexicons.themes[t]) for name, t in zip(RAW, THEMES, strict=True)})
    return out.withColumn("irrelevant_score", T.weighted(found(lexicons.irrelevant, "all"), lexicons.irrelevant))


def theme_scores(rows: DataFrame, lexicons: Lexicons) -> DataFrame:
    """_themes (scores in the order of THEMES), theme_max and theme: titles count four times, title boosts five a hit."""
    def score(theme: str) -> Column:
        lexicon = lexicons.themes[theme]
        title = T.weighted(T.matched_terms(F.col("_low_title"), F.col("_title_words"), list(lexicon)), lexicon, 4)
        body = T.weighted(T.matched_terms(F.col("_low_content"), F.col("_content_words"), list(lexicon)), lexicon)
        return title + body + 5 * F.size(T.matched_terms(F.col("_low_title"), F.col("_title_words"), lexicons.boosts[theme]))

    out = rows.withColumn("_themes", F.array(*[score(t) for t in THEMES])).withColumn("theme_max", F.array_max("_themes"))
    best = F.element_at(F.array(*[F.lit(t) for t in THEMES]), F.array_position("_themes", F.col("theme_max")).cast("int"))
    return out.withColumn("theme", F.when(F.col("theme_max") < 10, REGIONAL).otherwise(best))


def relevance(articles: DataFrame, lexicons: Lexicons) -> DataFrame:
    """articles with region_score, raw theme scores, relevance_score, relevant, category and reason."""
    rows = theme_scores(lexicon_scores(prepared(articles, lexicons), lexicons), lexicons)
    region, top = F.col("region_score"), F.col("theme_max")
    context = ~F.col("theme").isin(SPORTS, SECURITY) | F.col("_title_region") | (region >= 8)
    open_ = (region > 0) & context
    raw = 0.60 * F.least(F.lit(100), region) + 0.40 * F.least(F.lit(100), 2 * top) - F.least(F.lit(15), F.col("irrelevant_score"))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(raw.cast("double"), 0).cast("int")))
    rows = rows.withColumn("relevance_score", F.when(open_, score).otherwise(0))
    enough = (region >= 8) & (top >= 5)
    relevant = open_ & ((enough & (F.col("relevance_score") >= 20)) | (F.col("_title_region") & enough & (F.col("irrelevant_score") < 10)))
    # naming the partition keeps Catalyst from copying all lexicon tests into filters on the verdict
    rows = rows.withColumn("relevant", relevant & (F.spark_partition_id() >= 0))
    rows = rows.withColumn("category", F.when(F.col("relevant"), F.col("theme")).otherwise(NOT_RELEVANT))
    terms = F.when(open_, F.slice("_region_terms", 1, 6)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("reason_terms", F.array_join(terms, ", "))


def is_generic(rows_title: str, words: str, lexicons: Lexicons) -> Column:
    title = F.col(rows_title)
    starts = F.lit(False)
    for s in lexicons.generic_starts:
        starts = starts | title.startswith(s)
    return T.any_term(title, F.col(words), [t.replace("-", " ") for t in lexicons.generic_terms]) | starts


def title_first(lexicons: Lexicons, fallback: str = "category") -> Column:
    """The first category whose terms stand in the title, else the fallback column if it is one, else regional."""
    out = None
    for category in (SPORTS, SECURITY, DEVELOPMENT, SOCIETY, REGIONAL):
        test = T.any_term(F.col("_plain_title"), F.col("_plain_words"), list(dict.fromkeys(t.replace("-", " ") for t in lexicons.titles[category])))
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.when(F.col(fallback).isin(*CATEGORY_ORDER), F.col(fallback)).otherwise(REGIONAL)


def editorial(articles: DataFrame, lexicons: Lexicons) -> DataFrame:
    """relevance with editorial_category: generic, empty and not relevant rows out, else title first."""
    rows = relevance(articles, lexicons)
    empty = (F.col("_title") == "") & (F.col("_content") == "")
    out = F.when(empty | is_generic("_plain_title", "_plain_words", lexicons) | ~F.col("relevant"), NOT_RELEVANT).otherwise(title_first(lexicons))
    return rows.withColumn("editorial_category", out)


def category_counts(rows: DataFrame, column: str) -> DataFrame:
    """(category, n) for all categories, those without rows too."""
    known = rows.sparkSession.createDataFrame([(c,) for c in (*CATEGORY_ORDER, NOT_RELEVANT)], "category string")
    counts = rows.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
