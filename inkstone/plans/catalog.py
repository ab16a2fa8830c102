"""Registry of the queries built on the reference's own operators, over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import urls as U
from inkstone.functions.lexicons import CATEGORY_ORDER, FIXTURE, STOPWORDS
from inkstone.operators import analytics, classify, compose, dedup, grounding, ingest, lexicon, score, vector
from inkstone.operators import images as pictures
from inkstone.plans.oracles import SQL
from inkstone.plans.runner import run_stages
from inkstone.session import new_path, stored
from inkstone.sources import json_files
from inkstone.sources.fixtures import articles, drafts, images, table, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scored(s: SparkSession, d: str) -> DataFrame:
    return score.scored(classify.relevance(articles(s, d), FIXTURE), FIXTURE)


def _relevant(s: SparkSession, d: str) -> DataFrame:
    return ingest.relevant(_scored(s, d))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Classified, scored and ranked articles, the ten best."""
    rows = stored(_scored(s, d).select("id", "category", "relevance_score", "article_score", "published_date"), "scores")
    return score.ranked(rows).select("id", "category", "article_score", "rank").filter("rank <= 10")


@query
def validate_articles(s, d):
    e = ingest.validation_errors()
    return articles(s, d).select("id", F.array_join(e, ",").alias("errors"), (F.size(e) == 0).alias("valid"))


@query
def date_window(s, d):
    return articles(s, d).select("id", ingest.in_window(F.col("published_date")).alias("inside"))


@query
def ingest_funnel(s, d):
    a = articles(s, d)
    return ingest.funnel(a, a.filter("id % 20 = 0"))


@query
def insert_if_absent(s, d):
    a = articles(s, d).select("id", "url")
    return ingest.new_rows(a, a.filter("id % 20 = 0"))


@query
def article_exists(s, d):
    a = articles(s, d).select("id", "url")
    return ingest.known_rows(a, a.filter("id % 20 = 0"))


@query
def delete_by_predicate(s, d):
    a = articles(s, d)
    return ingest.without_title(a, a.agg(F.min("title")).first()[0]).select("id")


@query
def upsert(s, d):
    a = articles(s, d).select("id", F.lit("old").alias("origin"), F.lit(0).alias("seq"))
    return ingest.upserted(a, a.filter("id % 2 = 0").withColumn("origin", F.lit("new"))).select("id", "origin")


@query
def text_forms(s, d):
    c = F.col("content")
    return articles(s, d).select("id", F.md5(T.normalized(c)).alias("normal"), F.md5(T.normalized_hyphens(c)).alias("hyphens"), F.md5(T.normalized_words(c)).alias("words"), T.word_count(c).alias("n"))


@query
def markup_strip(s, d):
    i = F.col("id").cast("string")
    raw = F.concat(F.lit("**"), "title", F.lit("**  and  [Source "), i, F.lit("] more , text [source 2]."))
    return articles(s, d).select("id", T.without_markup(raw).alias("plain"))


@query
def lexicon_score(s, d):
    rows = classify.lexicon_scores(classify.prepared(articles(s, d), FIXTURE), FIXTURE)
    return rows.select("id", "region_score", F.col("_title_region").alias("title_region"), F.array_join("_region_terms", ",").alias("region_terms"), *classify.RAW, "irrelevant_score")


@query
def theme_classify(s, d):
    rows = classify.theme_scores(classify.prepared(articles(s, d), FIXTURE), FIXTURE)
    return rows.select("id", F.col("_themes").cast("string").alias("themes"), "theme_max", "theme")


@query
def relevance(s, d):
    return classify.relevance(articles(s, d), FIXTURE).select("id", "relevance_score", "relevant", "category", "reason_terms")


@query
def generic_content(s, d):
    return classify.prepared(articles(s, d), FIXTURE).select("id", classify.is_generic("_plain_title", "_plain_words", FIXTURE).alias("generic"))


@query
def title_first_category(s, d):
    return classify.relevance(articles(s, d), FIXTURE).select("id", classify.title_first(FIXTURE).alias("category"))


@query
def editorial_category(s, d):
    return classify.editorial(articles(s, d), FIXTURE).select("id", "editorial_category")


@query
def editorial_category_counts(s, d):
    return classify.category_counts(classify.editorial(articles(s, d), FIXTURE), "editorial_category")


@query
def score_components(s, d):
    return _scored(s, d).select("id", *[f"{k}_part" for k in ("region", "theme", "security", "freshness", "source", "content")])


@query
def composite_score(s, d):
    return _scored(s, d).select("id", "category", "article_score")


@query
def persisted_scores(s, d):
    return score.persisted(_scored(s, d)).select("id", "article_score", "theme_part", "security_part", "freshness_part", "source_part", "content_part")


@query
def article_rank(s, d):
    rows = stored(_scored(s, d).select("id", "relevance_score", "article_score", "published_date"), "scores")  # classified once, read twice
    return score.ranked(rows).select("id", "rank")


@query
def top_articles(s, d):
    return analytics.top(_relevant(s, d).select("id", "article_score"))


@query
def stats_overall(s, d):
    return analytics.overall(_relevant(s, d))


@query
def stats_category(s, d):
    return analytics.shares(_relevant(s, d), "category")


@query
def stats_source(s, d):
    return analytics.shares(_relevant(s, d), "source")


@query
def stats_daily(s, d):
    return analytics.daily(_relevant(s, d))


@query
def stats_entity_group(s, d):
    return analytics.group_coverage(articles(s, d), FIXTURE.groups)


@query
def source_appendix(s, d):
    return analytics.source_rows(articles(s, d))


@query
def category_lines(s, d):
    return analytics.category_lines(_relevant(s, d))


@query
def word_totals(s, d):
    return analytics.word_totals(articles(s, d))


@query
def edition_metadata(s, d):
    return analytics.edition(articles(s, d))


@query
def sentences(s, d):
    return articles(s, d).select("id", T.sentences(F.col("content")).alias("x")).select("id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("joined"))


@query
def keywords(s, d):
    return articles(s, d).select("id", F.array_join(T.keywords(F.col("title"), STOPWORDS), " ").alias("keywords"))


@query
def query_variants(s, d):
    asked = T.cleaned_query(F.concat(F.lit("Write an article about "), "title", F.lit(" using only retrieved evidence.")))
    return articles(s, d).select("id", asked.alias("q")).select("id", "q", F.array_join(T.query_variants(F.col("q"), STOPWORDS), "|").alias("variants"))


@query
def citations(s, d):
    i = F.col("id")
    raw = F.concat("title", F.lit(" [Source "), (i % 7).cast("string"), F.lit("] and [source  "), (i % 5).cast("string"), F.lit("] [Source x]"))
    return articles(s, d).select("id", F.array_join(T.citations(raw).cast("array<string>"), ",").alias("cited"), T.without_citations(raw).alias("plain"))


@query
def numbers_and_dates(s, d):
    raw = F.concat("content", F.lit(" On 5 March 2024, 2023-01-02 and 12/11/2020 it was 50% of 3.5 km in 1999."))
    # a column a step, so that no text is searched twice
    rows = articles(s, d).select("id", raw.alias("raw")).withColumns({"mentions": T.date_mentions(F.col("raw")), "numbers": T.numbers(F.col("raw"))})
    return rows.select("id", F.array_join("numbers", ",").alias("numbers"), F.array_join(T.dates(F.col("raw"), F.col("mentions")), ",").alias("dates"))


@query
def entities(s, d):
    return articles(s, d).select("id", F.array_join(grounding.entities(F.col("content"), FIXTURE.security_hits), ",").alias("entities"))


@query
def citation_sets(s, d):
    i = F.col("id")
    rows = articles(s, d).select("id", F.array(i % 3, i % 4, F.lit(9).cast("long")).alias("x"), F.array_distinct(F.array(i % 4, i % 5)).alias("y"))
    return rows.select(
        "id", F.array_sort(F.array_except("x", "y")).cast("string").alias("missing"), F.array_sort(F.array_except("y", "x")).cast("string").alias("invalid"),
        (F.array_sort(F.array_distinct("x")) == F.array_sort("y")).alias("agree"),
    )


@query
def url_discovery(s, d):
    """Pages of the fixture link to no article: each gets an own article link twice, a relative one, a category page and a foreign page,
    one without quotes, one with an entity, and one in a comment."""
    i = F.col("page_id").cast("string")
    link = lambda *parts: F.concat(F.lit('<a class="x" href="'), *parts, F.lit('">'))
    more = F.concat(link(F.lit("/news/story-"), i, F.lit("?ref=home")), link(F.lit("/news/story-"), i, F.lit("#top")), link(F.lit("/category/x/"), i), link(F.lit("https://other.example.org/news/x")), link(F.lit("/a/b/"), i),
                    F.lit("<a href=/news/plain-"), i, F.lit("><A class=y HREF='/news/that&amp;this-"), i, F.lit("'><!-- <a href=\"/news/hidden-"), i, F.lit("\"> -->"))
    return ingest.discovered(table(s, d, "pages").withColumn("html", F.concat(more, "html")))


@query
def url_parts(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", U.host(u).alias("host"), U.domain(u).alias("domain"), U.path(u).alias("path"), U.query(u).alias("query"), U.is_article(u).alias("article"))


@query
def domain_tier(s, d):
    return table(s, d, "pages").select("page_id", U.source_priority(F.col("url")).alias("tier"))


@query
def image_urls(s, d):
    p, i = F.col("page_id"), F.col("page_id").cast("string")
    tail = F.when(p % 4 == 0, F.concat(F.lit("/images/Photo-"), i, F.lit(".JPG?w=300&v="), i, F.lit("#x"))).when(p % 4 == 1, "/static/logo.png").when(p % 4 == 2, F.concat(F.lit("/media/"), i)).otherwise(F.concat(F.lit("/a/"), i, F.lit("-jpg.webp?b=2&a=1")))
    u = F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), tail)
    return table(s, d, "pages").select("page_id", U.is_image(u).alias("probable"), U.image_identity(u).alias("identity"))


@query
def html_extract(s, d):
    return ingest.extracted(table(s, d, "pages"))


@query
def dedup_exact_text(s, d):
    return dedup.exact_text(articles(s, d))


@query
def survivor_choice(s, d):
    return dedup.survivors(articles(s, d).select("id", "url", (F.col("id") * 37 % 11).alias("score"), F.length("content").alias("n")), "url").select("id", "url")


@query
def dedup_fuzzy(s, d):
    return dedup.deduplicated(articles(s, d).withColumn("score", F.col("id") * 37 % 101))


@query
def semantic_pairs(s, d):
    return vector.similar_pairs(vectors(s, d), 0.4).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query
def vector_topk(s, d):
    v = vectors(s, d)
    return vector.top_k(v.filter("id % 100 = 0"), v, 5).select("query_id", "id", F.round("similarity", 5).alias("similarity"), "place")


@query
def retrieval_metrics(s, d):
    v = vectors(s, d)
    hits = vector.top_k(v.filter("id % 100 = 0"), v, 5, own=False)
    hits = hits.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    places = hits.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("place"))).alias("relevant_place"), F.max("similarity").alias("top_similarity"))
    return vector.retrieval_metrics(places)


@query
def negative_rejection(s, d):
    """Opposite vectors as questions that nothing should answer."""
    v = vectors(s, d)
    asked = v.filter("id % 100 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return vector.negative_rejection(asked.select(F.col("id").alias("query_id")), vector.top_k(asked, v, 1), 0.45)


@query
def vector_info(s, d):
    return vector.collection_info(vector.checked(vectors(s, d), 64))


@query
def pipeline_metrics(s, d):
    i = F.col("id")
    rows = vectors(s, d).select((i % 2 == 0).alias("retrieval"), (i % 3 > 0).alias("json"), (i % 5 > 0).alias("citation"), F.when(i % 7 > 0, i % 4 == 0).alias("grounding"), (i % 11).alias("n_claims"), F.least(i % 11, i % 7).alias("n_supported"), F.when(i % 6 > 0, (i % 64) / 64.0).alias("top_similarity"))
    return vector.pipeline_metrics(rows, ("retrieval", "json", "citation", "grounding"))


@query
def retrieve(s, d):
    """Titles of every hundredth article as questions, over hashed embeddings, with the lexical fallback."""
    a = _scored(s, d).select("id", "title", "category", "source", "content", "article_score")
    corpus = vector.embedded(a.withColumn("t", F.concat_ws("\n\n", "title", "content")), "t").filter("embedding is not null").select("id", "embedding")
    asked = a.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    variants = asked.select("query_id", F.posexplode(T.query_variants(F.col("query"), STOPWORDS)).alias("variant", "v"))
    wanted = vector.embedded(variants, "v").filter("embedding is not null").select((F.col("query_id") * 8 + F.col("variant")).alias("id"), "embedding")
    hits = vector.top_k(wanted, corpus, 9).select(F.expr("query_id div 8").alias("query_id"), (F.col("query_id") % 8).alias("variant"), "id", "similarity")
    hits = vector.merged(hits).join(a.select("id", "title", "category", "source", "article_score"), "id").join(asked, "query_id")
    found = vector.retrieved(hits)
    rest = vector.lexical_fallback(hits.join(found.select("query_id").distinct(), "query_id", "left_anti"))
    return found.select("query_id", "id", F.lit("similarity").alias("how"), F.round("similarity", 4).alias("value")).unionAll(rest.select("query_id", "id", F.lit("lexical"), F.round("lexical", 4)))


@query
def claim_grounding(s, d):
    made, sources = drafts(s, d)
    return grounding.verified(grounding.claims(made), sources, terms=FIXTURE.security_hits, embed=vector.letter_vectors).withColumn("errors", F.array_join("errors", "; "))


@query
def claim_grounding_cached(s, d):
    """The same with each distinct sentence embedded once."""
    made, sources = drafts(s, d)
    judged = grounding.verified(grounding.claims(made), sources, terms=FIXTURE.security_hits, embed=vector.letter_vectors, cache=new_path(s, "sentences"))
    return judged.withColumn("errors", F.array_join("errors", "; "))


@query
def draft_verdicts(s, d):
    made, sources = drafts(s, d)
    judged = grounding.verified(grounding.claims(made), sources, terms=FIXTURE.security_hits, embed=vector.letter_vectors, similarity=False)
    return grounding.draft_verdicts(made, judged).withColumn("missing_ids", F.col("missing_ids").cast("string")).withColumn("invalid_ids", F.col("invalid_ids").cast("string"))


@query
def draft_status(s, d):
    made, sources = drafts(s, d)
    body = F.to_json(F.struct(F.lit("A headline").alias("headline"), "article", "source_ids"))
    answers = made.select("draft_id", F.when(F.col("draft_id") % 11 == 0, "no json").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("answer"))
    # stored, as it is read for the claims, for the verdicts and for the status
    parsed = stored(grounding.parsed_drafts(answers), "parsed")
    judged = grounding.verified(grounding.claims(parsed.filter("structure_error is null")), sources, terms=FIXTURE.security_hits, embed=vector.letter_vectors, similarity=False)
    verdicts = grounding.draft_verdicts(parsed.filter("structure_error is null"), judged)
    return grounding.draft_status(parsed, verdicts, sources.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n")))


def _statuses(s, d):
    made, sources = drafts(s, d)
    judged = grounding.verified(grounding.claims(made), sources, terms=FIXTURE.security_hits, embed=vector.letter_vectors, similarity=False)
    parsed = made.withColumn("headline", F.lit("A headline")).withColumn("structure_error", F.lit(None).cast("string"))
    return parsed, grounding.draft_status(parsed, grounding.draft_verdicts(made, judged), sources.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n")))


@query
def editorial_records(s, d):
    out = grounding.editorial_records(*_statuses(s, d))
    return out.select("draft_id", "status", "headline", F.md5("article").alias("article"), F.col("source_ids").cast("string").alias("source_ids"), "reason")


@query
def cited_metadata(s, d):
    made, sources = drafts(s, d)
    return grounding.cited_metadata(made, sources)


@query
def last_attempts(s, d):
    i = F.col("id")
    first = F.when(i % 3 == 0, "grounding_failed").when(i % 3 == 1, "success").otherwise("invalid_json")
    a = articles(s, d).select(i.alias("draft_id"), F.lit(1).alias("attempt"), first.alias("status"))
    return grounding.last_attempts(a.unionAll(a.select("draft_id", F.lit(2), F.when(F.col("draft_id") % 2 == 0, "success").otherwise("grounding_failed"))))


@query
def layout(s, d):
    return articles(s, d).select("id", compose.layout(T.word_count(F.col("content")), F.col("id") % 3 == 0).alias("layout"))


@query
def sections(s, d):
    return compose.sections(_relevant(s, d))


@query
def composition_order(s, d):
    return compose.composition_order(articles(s, d).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 17).alias("rank"))).select("id", "position")


@query
def page_chunks(s, d):
    return compose.chunks(articles(s, d).withColumn("has_image", F.col("id") % 3 == 0)).select("id", "part", "parts", "role", T.word_count(F.col("chunk")).alias("words"), F.md5("chunk").alias("chunk"))


def _plan(s, d):
    best = stored(analytics.top(_relevant(s, d).select("id", "category", "content", "article_score"), 11), "best")
    ordered = best.withColumn("position", F.col("id").cast("int")).withColumn("has_image", F.col("id") % 3 == 0)
    return compose.page_plan(ordered.select("id", "category", "position"), compose.chunks(ordered).select("id", "part"))


@query
def page_plan(s, d):
    return _plan(s, d)


@query
def page_plan_check(s, d):
    return compose.plan_check(_plan(s, d))


@query
def asset_lookup(s, d):
    a = articles(s, d).select("id")
    files = a.filter("id % 2 = 0").select("id", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("n")).select("id", F.format_string("data/img/%d-%d.jpg", F.col("id") * 7 % 10, "n").alias("path"))
    return compose.assets(a, files).select("id", U.asset_path(F.col("asset")).alias("asset"))


@query
def image_rank(s, d):
    return analytics.image_rank(images(s, d)).select("image_id", "article_id", "rank")


@query
def best_image(s, d):
    return analytics.best_image(images(s, d)).select("article_id", "image_id")


@query
def image_batch_summary(s, d):
    return analytics.batch_summary(images(s, d).select((F.col("image_id") % 3).alias("found"), (F.col("image_id") % 2).alias("kept")), ["found", "kept"])


@query
def hash_similarity(s, d):
    i = images(s, d).select(F.col("image_id").alias("a"), "hash")
    nxt = i.select((F.col("a") - 1).alias("a"), F.col("hash").alias("other"))
    return i.join(nxt, "a").select("a", F.round(dedup.hash_similarity(F.col("hash"), F.col("other")), 6).alias("similarity"))


@query
def image_dedup(s, d):
    return dedup.image_duplicates(images(s, d))


def _sign_hashes(s: SparkSession, d: str) -> DataFrame:
    """embeddings as images of one set, hashed to the signs of their 64 components."""
    signs = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, k: h.bitwiseOR(F.when(F.element_at("embedding", k + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(0)))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), signs.alias("hash"))


@query
def image_set_dedup(s, d):
    return dedup.distinct_images(_sign_hashes(s, d))


@query
def text_image_relevance(s, d):
    """Ten vectors in a row are one article: its text and nine images."""
    v = vectors(s, d).withColumn("article_id", F.expr("id div 10"))
    return vector.image_relevance(v.filter("id % 10 = 0").select("article_id", "embedding"), v.filter("id % 10 > 0").select("article_id", F.col("id").alias("image_id"), "embedding"), 0.10)


@query
def lexicon_hits(s, d):
    """The lexicons of regions and themes as one table, met with all texts."""
    named = {"states": FIXTURE.states, "entities": FIXTURE.entities, "region": FIXTURE.region, "irrelevant": FIXTURE.irrelevant, **FIXTURE.themes}
    terms = s.createDataFrame([(name, t, w) for name, weights in named.items() for t, w in weights.items()], "lexicon string, term string, weight int")
    texts = stored(classify.prepared(articles(s, d), FIXTURE).select("id", F.col("_all").alias("text")), "texts")
    return lexicon.lexicon_scores(lexicon.term_hits(texts, terms))


@query
def embedding_cache(s, d):
    """Titles twice through a cache: the second time nothing is embedded."""
    titles, path = articles(s, d).select("title"), new_path(s, "cache")
    _, first = vector.cached_embeddings(titles, "title", path, vector.letter_vectors)
    rows, again = vector.cached_embeddings(titles, "title", path, vector.letter_vectors)
    return rows.select("key", F.round(F.col("embedding")[0], 6).alias("share_of_a"), F.lit(first).cast("long").alias("embedded_first"), F.lit(again).cast("long").alias("embedded_again"))


@query
def generation_rounds(s, d):
    """A writer that first hands in the fixture's drafts, then leaves out what was not supported, and at last only quotes."""
    made, sources = drafts(s, d)

    def write(rows: DataFrame) -> DataFrame:
        listed = F.slice(F.split("correction", "\n"), 2, 1_000_000)
        corrected = F.aggregate(listed, F.col("article"), lambda text, claim: F.replace(text, claim, F.lit("")))
        quoted = F.concat(F.split("article", r"(?<=[.!?])\s")[0], F.lit(" [Source 1]"))
        article = F.when(F.col("outer") > 1, quoted).when(F.col("correction") != "", corrected).otherwise(F.col("article"))
        ids = F.when(F.col("outer") > 1, F.array(F.lit(1))).otherwise(F.col("source_ids"))
        return rows.select("draft_id", F.to_json(F.struct(F.lit("A headline").alias("headline"), article.alias("article"), ids.alias("source_ids"))).alias("answer"))

    _, results = grounding.generation_rounds(made, sources, write, terms=FIXTURE.security_hits, embed=vector.letter_vectors)
    return results.select("draft_id", "outer", "attempt", "status", F.md5("answer").alias("answer"))


@query
def image_queries(s, d):
    return articles(s, d).select("id", F.array_join(pictures.search_phrases(F.col("title"), F.col("source"), events=FIXTURE.security_hits, locations=("the", "ea", "que")), "|").alias("phrases"))


@query
def image_candidates(s, d):
    """Pages of the fixture have no images: each gets an og:image, a logo and two article images."""
    tag = F.concat(F.lit('<meta property="og:image" content="/media/'), "page_id", F.lit('.jpg?w=9"><article><img src="/logo.png"><img data-src="/media/'), "page_id", F.lit('.webp"><img src="/uploads/x"></article>'))
    return pictures.candidates(table(s, d, "pages").withColumn("html", F.concat(tag, "html")))


@query
def selection_reason(s, d):
    r = compose.selection_reason(F.when(F.col("id") % 5 == 0, "by hand"), F.col("category"), F.col("article_score"), F.col("security_part"))
    return _scored(s, d).select("id", r.alias("reason"))


@query
def record_normalise(s, d):
    a = articles(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("title")).alias("headline"), "title", "content", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("source")).alias("source"), F.col("id").cast("int").alias("source_id"))
    out = compose.normalized_record(a)
    return out.select("article_id", "headline", F.md5("body").alias("body"), "category", "source", F.col("source_ids").cast("string").alias("source_ids"), "words")


@query
def editorial_totals(s, d):
    return analytics.status_totals(articles(s, d).select(F.when(F.col("id") % 3 == 0, "failed").otherwise("success").alias("status")))


@query
def category_scan(s, d):
    return ingest.category_scan(_scored(s, d).select("id", "title", "category", "article_score"), CATEGORY_ORDER).select("id", "category", "position")


@query
def collection_funnel(s, d):
    a = articles(s, d)
    return ingest.collection_stats(a, a.filter("id % 20 = 0"), F.col("id") % 13 != 0)


@query
def json_lines(s, d):
    path = new_path(s, "lines")
    json_files.write_lines(articles(s, d).select("id", "title", "source"), path)
    return json_files.read_lines(s, path, "id long, title string, source string")


@query
def json_document(s, d):
    """The eleven best articles as one document, written and read again."""
    path = new_path(s, "document")
    best = stored(analytics.top(_relevant(s, d).select("id", "title", "category", "article_score"), 11), "best").withColumn("status", F.when(F.col("id") % 2 == 0, "approved").otherwise("failed"))
    made = json_files.document(best, "inkstone", score.START, score.END, "id")
    json_files.write_document(made, path)
    rows = json_files.read_records(s, path, "id long, title string, category string, status string")
    counts = s.read.text(path, wholetext=True).select(*[F.get_json_object("value", f"$.{c}_articles").cast("long").alias(c) for c in ("total", "approved", "failed")])
    return rows.crossJoin(F.broadcast(counts))  # one row of counts


@query
def document_texts(s, d):
    i, c = F.col("id"), F.col
    category = F.concat(F.lit("c"), (i % 5).cast("string"))
    whole = T.document_text(c("title"), c("source"), c("published_date"), category, c("content"))
    section = T.context_section(i % 9, i, c("title"), c("source"), F.date_format("published_date", "yyyy-MM-dd"), category, i % 101, (i % 100) / 100.0, c("content"))
    return articles(s, d).select("id", F.md5(whole).alias("document"), F.md5(T.embedding_text(c("title"), c("content"))).alias("embedding"), F.md5(section).alias("context"))


@query
def retrieval_query(s, d):
    opening = F.element_at(F.array(*[F.lit(x) for x in (*T.GENERATOR_STARTS, "tell me of")]), (F.col("id") % (len(T.GENERATOR_STARTS) + 1) + 1).cast("int"))
    return articles(s, d).select("id", T.retrieval_query(F.concat(F.initcap(opening), F.lit("  border towns "), F.col("id").cast("string"), F.lit("..."))).alias("asked"))


@query
def path_rewrite(s, d):
    p = F.concat(F.when(F.col("id") % 3 == 0, "/srv/edition/").when(F.col("id") % 3 == 1, "data/").otherwise("/other/"), F.lit("img/"), F.col("id").cast("string"), F.lit(".png"))
    return articles(s, d).select("id", U.relative_path(p, "/srv/edition").alias("relative"), U.asset_path(p).alias("asset"))


@query
def domain_quality(s, d):
    i = F.col("page_id")
    u = F.when(i % 6 == 0, "www.thehindu.com").when(i % 6 == 1, "News18.com").when(i % 6 == 2, "citymaps.example.com").when(i % 6 == 3, "").otherwise(U.host(F.col("url")))
    rows = table(s, d, "pages").select("page_id", U.source_quality_score(u).alias("quality"))
    return rows.withColumn("accepted", F.col("quality") > 0.10)


@query
def state_mentions(s, d):
    return analytics.mentions(articles(s, d).withColumn("content", F.concat("content", F.when(F.col("id") % 4 == 0, " From Assam and mizoram.").otherwise(" Assamese"))))


@query
def source_lines(s, d):
    return analytics.source_lines(articles(s, d))


@query
def selection_appendix(s, d):
    return compose.selection_appendix(_relevant(s, d).select("id", "title", "category", "source", "article_score", "security_part", (F.col("id") % 7).alias("position")))


@query
def toc(s, d):
    return compose.contents(_relevant(s, d).select("id", "title", "category"))


@query
def page_lookup(s, d):
    a = articles(s, d).select("id", "title", F.lit(1).alias("seq"))
    plan = a.select((F.col("id") + 1).alias("page_number"), F.when(F.col("id") % 5 == 0, "section").otherwise("article").alias("kind"), (F.col("id") * 3).alias("id"))
    return compose.page_lookup(plan, a).select("page_number", "id", "headline", "unresolved")


@query
def plan_offenders(s, d):
    i = F.col("id")
    plan = articles(s, d).select((i - F.when(i % 50 == 49, 1).otherwise(0)).alias("page_number"), F.when(i % 40 != 7, "article").alias("kind"), i, T.word_count(F.col("content")).alias("words"))
    return compose.plan_offenders(plan)


@query
def text_checks(s, d):
    return compose.text_checks(articles(s, d).select(F.col("id").alias("page_number"), F.col("content").alias("text")), ("the", "zzzz no such marker"))


def _text_findings(s, d):
    """Documents as pages; those of one source with an odd number of characters could not be read."""
    c = F.col("content")
    failed = F.when((F.col("source") == "src3") & (F.length(c) % 2 == 1), "no text layer")
    return compose.text_findings(articles(s, d).select((F.col("id") + 1).alias("page_number"), c.alias("text"), failed.alias("failure")), ("the", "zzzz no such marker"), least=300)


@query
def text_findings(s, d):
    return _text_findings(s, d)


@query
def text_accepted(s, d):
    return compose.accepted(_text_findings(s, d))


@query
def edition_checks(s, d):
    """Every document as an edition: its lines are the pages, its longer lines the articles; some lack keys, some hold no list."""
    lines = F.split("content", "\n")
    rows = articles(s, d).select(F.col("id").alias("edition"), "source", F.length("title").alias("n"), lines.alias("lines"))
    long = F.filter("lines", lambda x: F.length(x) > 150)
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    parts = F.array(
        *[part(k, F.lit("{}")) for k in ("metadata", "toc", "sections")], F.when(F.col("source") != "src1", part("charts", F.lit("null"))), F.when(F.col("n") % 9 > 0, part("validation", F.lit("true"))),
        part("articles", F.when(F.col("source") == "src2", F.lit('"[1]"')).otherwise(F.to_json(long))), part("page_plan", F.when(F.col("source") == "src4", F.lit("{}")).otherwise(F.to_json("lines"))),
    )
    body = F.when(F.col("source") != "src5", F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ","), F.lit("}"))).otherwise("not an edition")
    html = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('<section class="magazine-page text">'), F.substring(x, 1, 20), F.lit("</section>"))), "")
    return compose.edition_checks(rows.select("edition", body.alias("body"), html.alias("html")), 4)


@query
def migrated(s, d):
    out = ingest.migrated(articles(s, d).select("id", "title", (F.col("id") % 9).cast("int").alias("article_score")))
    return out.select("id", "article_score", "relevance_score", "rank", "category", F.lit(len(out.columns)).alias("columns"))


@query
def accepted_images(s, d):
    i = F.col("image_id")
    rows = images(s, d).select(
        "article_id", i.alias("position"), F.concat(F.lit("https://x.example.com/"), (i % 200).cast("string")).alias("image_url"), F.when(i % 5 == 0, "text/html").otherwise("image/JPEG; q=1").alias("mime"),
        F.encode(i.cast("string"), "utf-8").alias("payload"), (i % 700).alias("width"), (i % 500).alias("height"),
    )
    return ingest.accepted_images(rows, 2).select("article_id", "position", "image_url", "name")


@query
def search_results(s, d):
    p = F.col("page_id")
    own = table(s, d, "pages").select(p, F.lit(1).alias("place"), F.concat(F.lit("https://own.example.com/media/"), p.cast("string"), F.lit(".jpg")).alias("image_url")).filter("page_id % 3 > 0")
    hosts = ("https://thehindu.com/media/a", "https://eastmojo.com/media/b", "https://pinterest.com/media/c", "https://any.example.org/media/d", "https://any.example.org/media/e")
    found = table(s, d, "pages").select(p, F.posexplode(F.array(*[F.lit(h) for h in hosts])).alias("place", "h")).select("page_id", "place", F.concat("h", p.cast("string"), F.lit(".jpg")).alias("image_url"))
    return pictures.with_search_results(own, found, 4)


@query
def stage_runs(s, d):
    stages = [
        ("articles", lambda spark, _: articles(spark, d)), ("valid", lambda _, rows: rows.filter(F.size(ingest.validation_errors()) == 0)), ("in window", lambda _, rows: rows.filter(ingest.in_window(F.col("published_date")))),
    ]
    runs, _ = run_stages(s, stages)
    return s.createDataFrame([(r.place, r.stage, r.status, r.rows) for r in runs], "place int, stage string, status string, rows long")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
