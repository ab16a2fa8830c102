"""Scalar text functions as columns: all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character, for Java and RE2 alike.
WORD = r"[\p{L}\p{N}_]"
#: White space as a Unicode-aware set for Java and RE2 alike.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: SPACE for Java alone: most characters are discarded by two ranges, before the set is looked at.
_SPACE = r"[\x00-\x20\x{85}-\x{3000}&&" + SPACE + "]"
#: White space that is no blank, with all that follows, or a blank with more: what is left alone are single blanks.
_RUNS = f"{_SPACE}(?:(?<! )|{_SPACE}){_SPACE}*"


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def normalized(c: Column) -> Column:
    """Lower case, white space squeezed; null is empty."""
    return squeezed(F.lower(F.coalesce(c, F.lit(""))))


def normalized_hyphens(c: Column) -> Column:
    """normalized, with hyphens as blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[-" + SPACE[1:] + "+", " "))


def normalized_words(c: Column) -> Column:
    """Lower case, everything but word characters as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def page_text(c: Column) -> Column:
    """Line ends unified, blanks and tabs squeezed, at most one empty line in a row, trimmed."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"), rf"^{SPACE}+|{SPACE}+$", "")


def without_markup(c: Column) -> Column:
    """No bold marks or source citations, no doubled blanks, none before punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\*\*", ""), r"(?i)\[Source\s+\d+\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t]{2,}", " "), r" +([,.!?;:])", "$1"))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def tokens(c: Column, vocabulary: tuple[str, ...] | None = None) -> Column:
    """Distinct words of a lower-case text; with a vocabulary, those that are in it."""
    words = F.split(c, r"[^\p{L}\p{N}_]+")
    return F.array_distinct(words) if vocabulary is None else F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))


def words_of(terms: Iterable[str]) -> tuple[str, ...]:
    """The words of terms: the vocabulary that tells which of them a text can have."""
    return tuple(dict.fromkeys(w for t in terms for w in re.findall(r"\w+", t)))


def is_one_word(term: str) -> bool:
    return re.fullmatch(r"\w+", term) is not None


def bounded(text: Column, words: Column, term: str) -> Column:
    """Whether term stands in a lower-case text between word boundaries, with any white space for its blanks; words are the text's
    words, or those of them that are in words_of(terms): the text is searched only if it has all words of the term."""
    escaped = re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term)
    after = r"(?![\p{L}\p{N}_])" if re.search(r"\w$", term) else ""
    first, *rest = escaped.split(" ")
    odd = "" in (first, *rest) or re.search(r"[^\S ]", term)  # not squeezed itself, so that texts have to be
    first = escaped if odd else first
    before = rf"(?<![\p{{L}}\p{{N}}_]{first})" if re.match(r"\w", term) else ""
    test = F.lit(True)
    for w in words_of([term]):
        test = test & F.array_contains(words, w)
    if odd:
        return test & squeezed(text).rlike(first + before + after)
    return test & text.rlike((SPACE + "+").join([first + before, *rest]) + after)


def matched_terms(text: Column, words: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms found, in the order of terms: single words by one hash intersection, phrases one by one."""
    phrases = [t for t in terms if not is_one_word(t)]
    there = F.concat(words, F.array_compact(F.array(*[F.when(bounded(text, words, t), F.lit(t)) for t in phrases]))) if phrases else words
    return F.array_intersect(F.array(*[F.lit(t) for t in terms]), there)


def weighted(found: Column, weights: dict[str, int], times: int = 1) -> Column:
    table = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w * times)])
    return F.aggregate(F.transform(found, lambda t: table[t]), F.lit(0), lambda a, b: a + b)


def any_term(text: Column, words: Column, terms: list[str] | tuple[str, ...]) -> Column:
    single = [t for t in terms if is_one_word(t)]
    test = F.arrays_overlap(words, F.array(*[F.lit(t) for t in single])) if single else F.lit(False)
    for t in terms:
        if not is_one_word(t):
            test = test | bounded(text, words, t)
    return F.coalesce(test, F.lit(False))


def substring_terms(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms that stand anywhere in text, in their order. A test a term and no lambda, which would work out text anew for every term."""
    found = F.array(*[F.when(text.contains(t), F.lit(t)) for t in dict.fromkeys(terms)]).cast("array<string>")
    return F.array_except(found, F.array(F.lit(None).cast("string")))


def document_text(title: Column, source: Column, published: Column, category: Column, content: Column) -> Column:
    """The text of an article that is embedded and stored; null fields are empty."""
    day = F.date_format(published, "yyyy-MM-dd HH:mm:ss")
    title, source, day, category, content = (F.coalesce(c, F.lit("")) for c in (title, source, day, category, content))
    return F.concat(F.lit("Title: "), title, F.lit("\n\nSource: "), source, F.lit("\nPublished: "), day, F.lit("\nCategory: "), category, F.lit("\n\nContent:\n"), content)


def embedding_text(title: Column, content: Column) -> Column:
    """The shorter text that is compared for semantic duplicates."""
    return F.trim(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\nContent:\n"), F.coalesce(content, F.lit(""))))


def context_section(source_id: Column, article_id: Column, title: Column, source: Column, published: Column, category: Column, score: Column, similarity: Column, content: Column) -> Column:
    """One retrieved article as evidence in a request; the similarity has four decimals."""
    named = [("Article ID", article_id), ("Title", title), ("Source", source), ("Published Date", published), ("Category", category), ("Article Score", score), ("Retrieval Similarity", F.format_string("%.4f", similarity)), ("Content", content)]
    return F.concat(F.lit("[Source "), source_id.cast("string"), F.lit("]"), *[x for name, c in named for x in (F.lit(f"\n\n{name}:\n"), c.cast("string"))])


def keywords(c: Column, stopwords: tuple[str, ...]) -> Column:
    """Lower-case words of three letters or more that are no stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)*)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords))


#: Openings and endings of requests that are no part of the question.
REQUEST_STARTS = (
    "write a magazine article about", "write a magazine article on", "write an article about", "write an article on", "generate a magazine article about", "generate a magazine article on",
    "generate an article about", "generate an article on", "create a magazine article about", "create a magazine article on", "create an article about", "create an article on",
    "write about", "generate about", "create about",
)
REQUEST_ENDS = (
    r"\s+using only retrieved evidence.*$", r"\s+using only the retrieved evidence.*$", r"\s+using only supplied evidence.*$", r"\s+based only on retrieved evidence.*$",
    r"\s+from the retrieved sources.*$",
)


#: The openings that a generator's request loses.
GENERATOR_STARTS = (
    "write a magazine article about", "write an article about", "write a magazine article on", "write an article on", "write about", "generate a magazine article about",
    "generate an article about", "create a magazine article about", "create an article about",
)


def retrieval_query(c: Column) -> Column:
    """A generator's request without its opening and final full stops."""
    asked = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(?:" + "|".join(GENERATOR_STARTS) + r")\s*", "")
    return F.regexp_replace(asked, r"\.+$", "")


def cleaned_query(c: Column) -> Column:
    """The question without its request phrase; null if nothing is asked."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))
    asked = F.trim(F.regexp_replace(c, "(?i)^(" + "|".join(REQUEST_STARTS) + ")", ""))
    for end in REQUEST_ENDS:
        asked = F.regexp_replace(asked, "(?i)" + end, "")
    asked = F.regexp_replace(asked, r"^[ .,:;]+|[ .,:;]+$", "")
    return F.when(c != "", asked)


def query_variants(c: Column, stopwords: tuple[str, ...]) -> Column:
    low, words = F.lower(c), keywords(c, stopwords)
    swapped = [F.when(low.contains(a), F.replace(low, F.lit(a), F.lit("myanmar border"))) for a in ("india-myanmar", "india myanmar")]
    all_of = F.array_compact(F.array(c, low, F.when(F.size(words) >= 4, F.array_join(words, " ")), *swapped))
    return F.array_distinct(F.filter(F.transform(all_of, lambda v: F.trim(v)), lambda v: v != ""))


def sentences(c: Column) -> Column:
    # all white space is single blanks by then; a blank is looked for before what stands in front of it, as that is cheaper
    return F.filter(F.split(squeezed(F.coalesce(c, F.lit(""))), r" (?<=[.!?] )"), lambda s: s != "")


def opening_sentences(c: Column, n: int, least: int = 1000) -> Column:
    """The first n sentences of c, or all if there are fewer. Most texts have more than n in their first least characters, and then
    what follows cannot change the first n: only the others are read whole."""
    text = F.coalesce(c, F.lit(""))
    opening = sentences(F.substring(text, 1, least))
    return F.slice(F.transform(F.array(opening), lambda s: F.when(F.size(s) > n, s).otherwise(sentences(text)))[0], 1, n)


# Patterns of numbers, citations and dates.
NUMBER = r"(?i)\b\d+(?:\.\d+)?(?:\s*(?:kg|km|crore|lakh|million|billion|%|percent|years?|days?|hours?|months?))?\b"
CITATION = r"(?i)\[Source\s+(\d+)\]"


def _all_with_digits(c: Column, pattern: str, first: str = "[0-9]") -> Column:
    """All matches of a pattern that needs a digit and begins with one of first (which is tested before the pattern, as it is
    cheaper); texts without a digit are not searched."""
    return F.when(c.rlike("[0-9]"), F.regexp_extract_all(c, F.lit(f"(?i)(?={first}){pattern}"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def numbers(c: Column) -> Column:
    return F.transform(_all_with_digits(F.coalesce(c, F.lit("")), f"({NUMBER})"), lambda n: F.lower(F.trim(n)))


def citations(c: Column) -> Column:
    """Distinct source numbers, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))))


def without_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), CITATION, ""))


_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"(?i)\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\s+\d{{4}})\b"


def parsed_date(c: Column) -> Column:
    """A calendar date from the accepted forms (day before month), or null."""
    day = F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"\s+", " ")
    titled = F.initcap(F.lower(day))
    tries = [(day, f) for f in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "M-d-yyyy")] + [(titled, f) for f in ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")]
    return F.coalesce(*[F.try_to_date(x, f) for x, f in tries])


def date_mentions(c: Column) -> Column:
    """Stretches of text in the accepted forms of a date."""
    return _all_with_digits(F.coalesce(c, F.lit("")), f"({DATE})", "[0-9JFMASOND]")


def dates(c: Column, mentions: Column | None = None) -> Column:
    """ISO dates and standalone years outside them, distinct, ascending; mentions: date_mentions of c as a column, for long texts."""
    c = F.coalesce(c, F.lit(""))
    raw = date_mentions(c) if mentions is None else mentions
    known = F.filter(raw, lambda d: parsed_date(d).isNotNull())
    iso = F.transform(known, lambda d: F.date_format(parsed_date(d), "yyyy-MM-dd"))
    rest = F.aggregate(known, c, lambda text, d: F.replace(text, d, F.lit(" ")))
    years = _all_with_digits(rest, r"\b(\d{4})\b")
    return F.array_sort(F.array_distinct(F.concat(iso, years)))


def first_filled(*columns: Column, blank: bool = False) -> Column:
    """The first that is not null and not empty (with blank: not blank either)."""
    return F.coalesce(*[F.when((F.trim(c) if blank else c) != "", c) for c in columns])
