"""Claims against cited evidence: facts, similarity of sentences, verdicts; drafts and their status."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.lexicons import CLAIM_ENTITIES
from inkstone.operators.vector import embedded_once, hashed_vectors
from inkstone.session import stored

SIMILAR = 0.45
#: Texts that are embedded together, and those of the row that completes them.
EMBEDDED = 1024
#: Characters of a source that are read before the rest of it, where it is enough that a claim is supported.
OPENING = 1000
_FIRST = r"(\d+(?:\.\d+)?)"


def entities(c: Column, terms: tuple[str, ...] = CLAIM_ENTITIES) -> Column:
    """Those of terms that stand in c, ascending."""
    return T.substring_terms(F.lower(F.coalesce(c, F.lit(""))), sorted(set(terms)))


def _leading(fact: Column) -> Column:
    return F.regexp_extract(fact, _FIRST, 1)


def claim_facts(claim: Column, terms: tuple[str, ...] = CLAIM_ENTITIES) -> dict[str, Column]:
    """The numbers, dates and entities that a claim states, by these names."""
    return {"numbers": T.numbers(claim), "dates": T.dates(claim), "entities": entities(claim, terms)}


def with_facts(sources: DataFrame, terms: tuple[str, ...] = CLAIM_ENTITIES) -> DataFrame:
    """sources with known: numbers and dates (normalised) with their leading numbers, and entities; each found once for all claims.

    sources have has_numbers, has_dates and has_entities, which tell whether any claim on the source states such facts: where none
    does, none can be wrong, and the text is not searched for them.
    Every step is a column of its own: an expression named twice in one step would read the text twice."""
    asked = lambda kind, found: F.when(F.col(f"has_{kind}"), found).otherwise(F.array().cast("array<string>"))
    content = F.col("content")
    rows = sources.withColumns({"_mentions": asked("dates", T.date_mentions(content)), "_numbers": asked("numbers", T.numbers(content)), "_entities": asked("entities", entities(content, terms))})
    rows = rows.withColumn("_dates", asked("dates", T.dates(content, F.col("_mentions"))))
    told = lambda facts: F.struct(F.transform(facts, T.normalized).alias("whole"), F.filter(F.transform(facts, _leading), lambda x: x != "").alias("leading"))
    known = F.struct(told(F.col("_numbers")).alias("numbers"), told(F.col("_dates")).alias("dates"), F.col("_entities").alias("entities"))
    return rows.withColumn("known", known).drop("_mentions", "_numbers", "_dates", "_entities")


def unknown_facts(facts: Column, known: Column) -> Column:
    """Facts that the source lacks: neither the same text nor the same leading number."""
    return F.filter(facts, lambda f: ~(F.array_contains(known["whole"], T.normalized(f)) | ((_leading(f) != "") & F.array_contains(known["leading"], _leading(f)))))


def fact_errors(stated: dict[str, Column], known: Column) -> Column:
    """The claim_facts of a claim that the source lacks."""
    label = lambda what, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{what}: "), x))
    return F.concat(
        label("number", unknown_facts(stated["numbers"], known["numbers"])), label("date", unknown_facts(stated["dates"], known["dates"])),
        label("entity", F.array_except(stated["entities"], known["entities"])),
    )


def claims(drafts: DataFrame) -> DataFrame:
    """(draft_id, paragraph, sentence, claim, cited) of drafts (draft_id, article, source_ids).

    A paragraph is a line; lines of citations only are left out. Uncited paragraphs take the draft's only valid citation if it
    has no invalid one; else those of 8 words or more are one claim each with cited empty, and shorter ones are left out."""
    none = F.array().cast("array<int>")
    # every step is a column, so that no text is searched twice
    rows = drafts.select("draft_id", "article", F.coalesce("source_ids", none).alias("_known"), T.citations(F.col("article")).alias("_cited"))
    rows = rows.withColumns({"_valid": F.array_intersect("_cited", "_known"), "_invalid": F.array_except("_cited", "_known")})
    given = F.when((F.size("_valid") == 1) & (F.size("_invalid") == 0), F.col("_valid")).otherwise(none)
    lines = rows.select("draft_id", given.alias("_given"), F.posexplode(F.split(F.coalesce("article", F.lit("")), "\n")).alias("paragraph", "_line"))
    lines = lines.withColumns({"_own": T.citations(F.col("_line")), "_plain": T.without_citations(F.col("_line"))}).filter(F.col("_plain") != "")
    lines = lines.withColumn("cited", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_given")))
    lines = lines.filter((F.size("cited") > 0) | (T.word_count(F.col("_plain")) >= 8))
    parts = F.when(F.size("cited") == 0, F.array("_plain")).otherwise(T.sentences(F.col("_plain")))
    return lines.select("draft_id", "paragraph", "cited", F.posexplode(parts).alias("sentence", "claim"))


def _sentences(text: str | None) -> list[str]:
    """T.sentences of a text: what str.split takes as white space is T.SPACE."""
    squeezed = " ".join((text or "").split())
    # no line ends are left in it, so that they can part the sentences
    return squeezed.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if squeezed else []


def _highest(rows: Iterable[tuple[list[str], list[str]]], embed: Callable[[pd.Series], pd.Series]) -> Iterator[list[float]]:
    """Of each (claims, sentences), per claim the highest similarity to a sentence (0 without any). Texts of many rows are embedded together."""
    texts, spans = [], []  # claims and sentences of some rows, and where those of a row begin, part and end

    def found() -> Iterator[list[float]]:
        vectors = list(embed(pd.Series(texts, dtype=object)))
        size = next((len(v) for v in vectors if v is not None), 1)
        matrix = np.array([np.zeros(size) if v is None else v for v in vectors], np.float64)
        for i, j, k in spans:
            yield (matrix[i:j] @ matrix[j:k].T).max(axis=1).tolist() if j < k else [0.0] * (j - i)

    for claimed, told in rows:
        begin = len(texts)
        texts += claimed
        texts += told
        spans.append((begin, begin + len(claimed), len(texts)))
        if len(texts) >= EMBEDDED:
            yield from found()
            texts, spans = [], []
    if spans:
        yield from found()


def _nearest_of_texts(both: DataFrame, embed: Callable[[pd.Series], pd.Series], enough: float | None = None) -> DataFrame:
    """both with near, per claim asked the highest similarity to a sentence of content (0 without any), in place of content.

    With enough it need not be the highest where it is at least that, or where the claim has errors anyway: sources whose openings have
    such a sentence for every other claim are not cut and embedded beyond them, as no further sentence can lower it; all others are,
    to their ends."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, content = b.column(2), b.column(3)
            flat, ends = asked.flatten(), np.cumsum(pc.list_value_length(asked).to_numpy())
            claimed = pc.struct_field(flat, "claim").to_pylist()
            # the claims of each row that are compared, as places in claimed
            spans = [range(i, j) for i, j in zip([0, *ends], ends, strict=False)]
            if enough is not None:
                sound = pc.equal(pc.list_value_length(pc.struct_field(flat, "errors")), 0).to_pylist()
                spans = [[k for k in span if sound[k]] for span in spans]
            values, rest = np.zeros(len(claimed)), [row for row, span in enumerate(spans) if span]

            def compared(rows: list[int], sentences: Callable[[int], list[str]]) -> None:
                for row, found in zip(rows, _highest((([claimed[k] for k in spans[row]], sentences(row)) for row in rows), embed), strict=True):
                    values[spans[row]] = found

            if enough is not None:
                # the last sentence of an opening may go on behind it
                openings = pc.utf8_slice_codeunits(content, 0, OPENING)
                compared(rest, lambda row: _sentences(openings[row].as_py())[:-1])
                rest = [row for row in rest if values[spans[row]].min() < enough]
            compared(rest, lambda row: _sentences(content[row].as_py()))
            found = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found], names=["draft_id", "source_id", "asked", "near"])

    blank = both.select("draft_id", "source_id", "asked", F.array().cast("array<double>").alias("near"))
    return both.select("draft_id", "source_id", "asked", "content").mapInArrow(near, blank.schema)


def _nearest_of_vectors(both: DataFrame, embed: Callable[[pd.Series], pd.Series], cache: str) -> DataFrame:
    """As _nearest_of_texts, with vectors that are looked up by the SHA-256 of their text; both is a stored table.

    Places and keys are shuffled, never texts; the vectors of one source meet those of its claims in one row."""
    key = ["draft_id", "source_id"]
    # keys as 32 bytes, not as the 64 letters that the cache has
    digest = lambda xs: F.transform(xs, lambda t: F.unhex(F.sha2(t.cast("binary"), 256)))
    texts = both.select(F.explode(F.concat(F.transform("asked", lambda a: a["claim"]), F.coalesce("told", F.array().cast("array<string>")))).alias("text"))
    embedded_once(texts, "text", cache, embed)
    vectors = both.sparkSession.read.schema("key string, embedding array<double>").parquet(cache).select(F.unhex("key").alias("key"), "embedding")
    parts = F.array(F.struct(F.lit(0).alias("side"), digest(F.transform("asked", lambda a: a["claim"])).alias("keys")), F.struct(F.lit(1).alias("side"), digest(F.coalesce("told", F.array().cast("array<string>"))).alias("keys")))
    places = both.select(*key, F.explode(parts).alias("p")).select(*key, "p.side", F.posexplode("p.keys").alias("place", "key"))
    met = places.join(vectors, "key", "left").groupBy(*key).agg(F.collect_list(F.struct("side", "place", "embedding")).alias("_found"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, out, first = b.column(2).flatten(), [], 0
            side, place = (pc.struct_field(flat, k).to_numpy() for k in ("side", "place"))
            vectors = pc.struct_field(flat, "embedding")
            # components of all vectors in a row, and where each begins: no component becomes an object
            there, values = vectors.is_valid().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())
            for many in pc.list_value_length(b.column(2)).to_pylist():
                order = first + np.lexsort((place[first : first + many], side[first : first + many]))
                known = there[order]
                size = int(ends[order[known][0]] - (ends[order[known][0] - 1] if order[known][0] else 0)) if known.any() else 1
                matrix = np.zeros((many, size))
                matrix[known] = values[(ends[order[known]] - size)[:, None] + np.arange(size)]
                n = int((side[order] == 0).sum())
                out.append((matrix[:n] @ matrix[n:].T).max(axis=1).tolist() if n < many else [0.0] * n)
                first += many
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.list_(pa.float64()))], names=[*key, "near"])

    nearest = met.select(*key, "_found").mapInArrow(near, "draft_id long, source_id int, near array<double>")
    return both.select(*key, "asked").join(nearest, key).select(*key, "asked", "near")


def verified(claim_rows: DataFrame, sources: DataFrame, least: float = SIMILAR, terms: tuple[str, ...] = CLAIM_ENTITIES, embed: Callable[[pd.Series], pd.Series] = hashed_vectors, cache: str | None = None, similarity: bool = True) -> DataFrame:
    """(draft_id, paragraph, sentence, source_id, similarity, errors, supported); sources are (draft_id, source_id, content),
    one row each. Without similarity, that column is left out, and a source is compared only until each of its claims is similar enough.

    Citations of sources that are not there, and claims without citation, stay as unsupported rows. The claims on one source
    (they are all of one draft) meet its sentences and facts in one row, where each is embedded. With a cache (a path in the shared
    folder) each distinct sentence is embedded once over all drafts and runs, for embedders that cost more than a join."""
    kinds = ("numbers", "dates", "entities")
    rows = claim_rows.withColumns(claim_facts(F.col("claim"), terms)).withColumn("source_id", F.explode_outer("cited")).drop("cited")
    key = ["draft_id", "source_id"]
    asked = rows.filter("source_id is not null").groupBy(*key).agg(F.collect_list(F.struct("paragraph", "sentence", "claim", *kinds)).alias("asked"), *[F.bool_or(F.size(k) > 0).alias(f"has_{k}") for k in kinds])
    contents = sources.select(*[F.col(k).cast(t) for k, t in zip(key, ("long", "int"), strict=True)], "content")
    both = asked.select(F.col("draft_id").cast("long"), F.col("source_id").cast("int"), "asked", *[f"has_{k}" for k in kinds]).join(contents, key, "left")
    # facts and sentences only of sources that are asked for; one that is missing has none
    there = F.col("content").isNotNull()
    errors = lambda a: F.when(there, fact_errors({k: a[k] for k in kinds}, F.col("known"))).otherwise(F.array(F.lit("source not available")))
    both = with_facts(both, terms).withColumn("asked", F.transform("asked", lambda a: F.struct(a["paragraph"].alias("paragraph"), a["sentence"].alias("sentence"), a["claim"].alias("claim"), errors(a).alias("errors"))))
    if cache is None:
        judged = _nearest_of_texts(both, embed, None if similarity else least)
    else:
        told = F.when(there, T.sentences(F.col("content")))
        judged = _nearest_of_vectors(stored(both.select(*key, "asked", told.alias("told")), "asked", "zstd"), embed, cache)
    judged = judged.select(*key, F.explode(F.arrays_zip("asked", "near")).alias("x")).select(*key, "x.asked.*", "x.near")
    cited = judged.select("draft_id", "paragraph", "sentence", "source_id", F.round(F.greatest("near", F.lit(0.0)), 6).alias("similarity"), "errors")
    uncited = rows.filter("source_id is null").select(F.col("draft_id").cast("long"), "paragraph", "sentence", F.col("source_id").cast("int"), F.lit(0.0).alias("similarity"), F.array(F.lit("no citation")).alias("errors"))
    judged = cited.unionAll(uncited).withColumn("supported", (F.size("errors") == 0) & (F.col("similarity") >= least))
    return judged if similarity else judged.drop("similarity")


def draft_verdicts(drafts: DataFrame, judged: DataFrame) -> DataFrame:
    """Per draft: claims, supported, grounding_score, grounded, and the cited ids that are missing or invalid."""
    counts = judged.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("supported").alias("n_supported"), F.count_if(F.array_contains("errors", "no citation")).alias("n_uncited"))
    cited, ids = T.citations(F.col("article")), F.array_sort(F.array_distinct(F.coalesce("source_ids", F.array().cast("array<int>"))))
    rows = drafts.withColumn("missing_ids", F.array_except(ids, cited)).withColumn("invalid_ids", F.array_except(cited, ids)).join(counts, "draft_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = rows.select("draft_id", "missing_ids", "invalid_ids", zero("n_claims"), zero("n_supported"), zero("n_uncited"))
    score = F.when(F.col("n_claims") > 0, F.round(100.0 * F.col("n_supported") / F.col("n_claims"), 2)).otherwise(0.0)
    sound = (F.col("n_claims") > 0) & (F.col("n_supported") == F.col("n_claims")) & (F.size("invalid_ids") == 0) & (F.col("n_uncited") == 0)
    return rows.withColumn("grounding_score", score).withColumn("grounded", sound)


def citations_agree(article: Column, declared: Column) -> Column:
    return F.array_sort(F.array_distinct(declared)) == T.citations(article)


def cited_metadata(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """(draft_id, source_id, title) of every declared source; missing is true where there is none."""
    rows = drafts.select("draft_id", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    return rows.join(sources.select("draft_id", "source_id", "title"), ["draft_id", "source_id"], "left").withColumn("missing", F.col("title").isNull())


def unfenced(text: str | None) -> str:
    """A model's answer without white space and fences around it."""
    body = _FENCE.sub("", (text or "").strip(), count=1)
    return body[:-3].rstrip() if body.endswith("```") else body


def repaired_json(text: str | None) -> str | None:
    """The JSON object in a model's answer as compact text: fences off, outermost braces, raw line ends and tabs inside strings
    escaped; null if there is none."""
    body = unfenced(text)

    def tries() -> Iterator[str]:
        # each is only made if those before it are no objects
        yield body
        if "{" in body and "}" in body:
            yield (inner := body[body.index("{") : body.rindex("}") + 1])
            yield _QUOTED.sub(lambda m: m[0].replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"), inner)

    for t in tries():
        try:
            if isinstance(found := json.loads(t), dict):
                return json.dumps(found, ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


_FENCE = re.compile(r"\A```(?:json)?\s*", re.IGNORECASE)
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def structure_error(text: str | None) -> str | None:
    """What is wrong with a draft's JSON, or null: headline and article filled strings, source_ids whole numbers."""
    if text is None:
        return "invalid_json"
    found = json.loads(text)
    for key in ("headline", "article", "source_ids"):
        if key not in found:
            return f"missing {key}"
    for key in ("headline", "article"):
        if not isinstance(found[key], str) or not found[key].strip():
            return f"bad {key}"
    ids = found["source_ids"]
    return None if isinstance(ids, list) and all(isinstance(x, int) and not isinstance(x, bool) for x in ids) else "bad source_ids"


def parsed_drafts(answers: DataFrame) -> DataFrame:
    """(draft_id, headline, article, source_ids, structure_error) of answers (draft_id, answer)."""

    @F.pandas_udf("struct<body:string,problem:string>")
    def read(a: pd.Series) -> pd.DataFrame:
        bodies = [repaired_json(x) for x in a]
        return pd.DataFrame({"body": bodies, "problem": [structure_error(b) for b in bodies]})

    rows = answers.select("draft_id", read("answer").alias("r"))
    told = F.from_json(F.when(F.col("r.problem").isNull(), F.col("r.body")), "headline string, article string, source_ids array<int>")
    return rows.select("draft_id", told.alias("d"), F.col("r.problem").alias("structure_error")).select("draft_id", "d.headline", "d.article", "d.source_ids", "structure_error")


def draft_status(parsed: DataFrame, verdicts: DataFrame, n_sources: DataFrame) -> DataFrame:
    """(draft_id, status): the first step that fails, or success; n_sources is (draft_id, n)."""
    rows = parsed.join(verdicts, "draft_id", "left").join(n_sources, "draft_id", "left")
    agree = citations_agree(F.col("article"), F.col("source_ids"))
    status = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "insufficient_evidence").when(F.col("structure_error") == "invalid_json", "invalid_json").when(F.col("structure_error").isNotNull(), "invalid_structure")
        .when(~F.coalesce(agree, F.lit(False)) | (F.size("source_ids") == 0), "citation_failed").when(F.col("n_claims").isNull(), "grounding_error").when(~F.col("grounded"), "grounding_failed").otherwise("success")
    )
    return rows.select("draft_id", status.alias("status"))


def generation_rounds(
    requests: DataFrame, sources: DataFrame, generate: Callable[[DataFrame], DataFrame], inner: int = 2, outer: int = 2, terms: tuple[str, ...] = CLAIM_ENTITIES, embed: Callable[[pd.Series], pd.Series] = hashed_vectors
) -> tuple[DataFrame, DataFrame]:
    """(attempts, results) of writing a draft for each request until one is sound.

    generate takes rows (the requests' columns, outer, attempt, correction) and gives (draft_id, answer). Each attempt of all open
    requests is one round: answers are parsed, judged against sources and stored. Only grounding_failed is tried again with a
    correction that lists the unsupported claims, up to inner attempts; what then is no success begins anew, up to outer times,
    without a correction. attempts: (draft_id, outer, attempt, status, correction); results: the attempt that ended each request,
    with answer. A request without sources ends at once, as insufficient_evidence."""
    n_sources = stored(sources.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n")), "n_sources")
    open_, tried, evidence = requests, [], sources
    for o in range(1, outer + 1):
        now = open_.withColumn("correction", F.lit(""))
        for a in range(1, inner + 1):
            if tried and evidence is sources:
                # drafts that the first attempt ended are never asked for again, nor are their sources
                left = stored(tried[0].filter("status not in ('success', 'insufficient_evidence')").select("draft_id"), "left")
                evidence = stored(sources.join(left, "draft_id", "left_semi"), "evidence")
            asked = now.withColumn("outer", F.lit(o)).withColumn("attempt", F.lit(a))
            answers = stored(generate(asked).select("draft_id", "answer"), "answers")
            parsed = stored(parsed_drafts(answers), "parsed")
            sound = parsed.filter("structure_error is null")
            told = stored(claims(sound), "claims")
            judged = stored(verified(told, evidence, terms=terms, embed=embed, similarity=False), "judged")
            status = draft_status(parsed, draft_verdicts(sound, judged), n_sources)
            wrong = judged.filter(~F.col("supported")).select("draft_id", "paragraph", "sentence").distinct().join(told.select("draft_id", "paragraph", "sentence", "claim"), ["draft_id", "paragraph", "sentence"])
            listed = wrong.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "sentence", "claim"))).alias("_wrong"))
            note = F.concat(F.lit("Not supported:\n"), F.array_join(F.transform("_wrong", lambda w: w["claim"]), "\n"))
            done = asked.select("draft_id", "outer", "attempt", "correction").join(status, "draft_id").join(answers, "draft_id").join(listed.select("draft_id", note.alias("_note")), "draft_id", "left")
            done = stored(done.withColumn("_note", F.coalesce("_note", F.lit("Use only what the sources say."))), "attempts")
            tried.append(done)
            again = done.filter("status = 'grounding_failed'").select("draft_id", F.col("_note").alias("correction"))
            now = now.drop("correction").join(again, "draft_id")
            if a < inner and again.isEmpty():
                break
        every = tried[0]
        for t in tried[1:]:
            every = every.unionAll(t)
        ended = every.filter("status in ('success', 'insufficient_evidence')").select("draft_id").distinct()
        open_ = open_.join(ended, "draft_id", "left_anti")
        if o < outer and open_.isEmpty():
            break
    last = Window.partitionBy("draft_id").orderBy(F.col("outer").desc(), F.col("attempt").desc())
    results = every.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("draft_id", "outer", "attempt", "status", "answer")
    return every.select("draft_id", "outer", "attempt", "status", "correction"), results


def last_attempts(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Of each draft's attempts (draft_id, attempt, status), the one that ends the loop: only grounding_failed tries again."""
    first = Window.partitionBy("draft_id").orderBy("attempt")
    done = attempts.filter(F.col("attempt") <= most).withColumn("_again", F.lag(F.col("status") == "grounding_failed").over(first))
    upto = F.min(F.coalesce("_again", F.lit(True)).cast("int")).over(first)
    rows = done.withColumn("_open", upto).filter("_open = 1")
    last = Window.partitionBy("draft_id").orderBy(F.col("attempt").desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("draft_id", "attempt", "status")


def editorial_records(drafts: DataFrame, statuses: DataFrame) -> DataFrame:
    """(draft_id, status, headline, article, source_ids, reason): approved drafts with their text, failed ones with the step that failed."""
    good = F.col("status") == "success"
    rows = statuses.join(drafts.select("draft_id", "headline", "article", "source_ids"), "draft_id", "left")
    text = lambda c: F.when(good, F.coalesce(c, F.lit(""))).otherwise("").alias(c)
    ids = F.when(good, F.col("source_ids")).otherwise(F.array().cast("array<int>")).alias("source_ids")
    return rows.select("draft_id", F.when(good, "approved").otherwise("failed").alias("status"), text("headline"), text("article"), ids, F.when(~good, F.col("status")).alias("reason"))
