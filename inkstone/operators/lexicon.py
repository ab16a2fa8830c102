"""Lexicons as tables: terms of any number met with texts by equi-joins, in a plan that doesn't grow with them.

A term's head is its longest word. Distinct words of a text meet heads by a join (broadcast below a checked number of terms,
shuffled above); a term of one word is found with that, a phrase is then looked for in the texts that have its head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import WORD
from inkstone.session import stored

#: Terms up to which the lexicon is broadcast (a hundred bytes each).
BROADCAST_TERMS = 200_000


def headed(lexicon: DataFrame) -> DataFrame:
    """lexicon (lexicon, term, weight) with head, one (the term is one word) and pattern (the term between word boundaries).

    Terms without a word are an error: no text could be found for them but by reading all."""
    words = F.regexp_extract_all("term", F.lit(f"({WORD}+)"), F.lit(1))
    head = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    literal = F.regexp_replace("term", r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    left = F.when(F.col("term").rlike(f"^{WORD}"), rf"(^|[^\p{{L}}\p{{N}}_])").otherwise("")
    right = F.when(F.col("term").rlike(f"{WORD}$"), rf"($|[^\p{{L}}\p{{N}}_])").otherwise("")
    known = F.when(F.size(words) > 0, head).otherwise(F.raise_error(F.concat(F.lit("a term without a word: "), F.coalesce("term", F.lit("null")))))
    return lexicon.select("lexicon", "term", "weight", known.alias("head"), F.col("term").rlike(f"^{WORD}+$").alias("one"), F.concat(left, literal, right).alias("pattern"))


def term_hits(texts: DataFrame, lexicon: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(id, lexicon, term, weight): the terms of lexicon (lexicon, term, weight) that stand in normalised texts (id, text), each once.

    Null texts and repeated terms count as none and one; a text of any length is read whole, and only where it has a head again."""
    lexicon = stored(headed(lexicon.dropDuplicates(["lexicon", "term"])), "lexicon")
    heads = F.broadcast(lexicon) if lexicon.count() <= broadcast_terms else lexicon
    words = texts.filter(F.col("text").isNotNull()).select("id", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_]+"))).alias("head"))
    met = stored(words.join(heads, "head").drop("head"), "met")
    single = met.filter("one").select("id", "lexicon", "term", "weight")
    sought = met.filter(~F.col("one")).join(texts.select("id", "text"), "id")
    found = sought.filter(F.contains("text", "term") & F.regexp(F.col("text"), F.col("pattern")))
    return single.unionAll(found.select("id", "lexicon", "term", "weight"))


def lexicon_scores(hits: DataFrame) -> DataFrame:
    """(id, lexicon, score, n_terms) of term_hits."""
    return hits.groupBy("id", "lexicon").agg(F.sum("weight").cast("long").alias("score"), F.count(F.lit(1)).alias("n_terms"))
