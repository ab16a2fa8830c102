"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` measures every text once and stores, per document, the measurements and one
integer whose bit k says that rule k failed. Policies are masks over these bits, so a new
policy version or an ablation reads the small ledger and never the texts:
``apply_policy`` decides, ``ablation`` counts through bitwise aggregation.

Defined cases: null text counts as empty (no words); an empty table gives an empty ledger;
repeated rows are each measured; other columns are carried through only by ``filtered``;
documents of any length are measured whole. Equality of windows is equality of a chained
64-bit hash of their eight words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import SPACE_CLASS, text_or_empty

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A failure test over the measurements; SQL text that Spark and DuckDB read alike."""

    name: str
    fails: str


#: Bit k belongs to RULES[k]; append only, so that stored ledgers keep their meaning.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "100 * n_upper > 40 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def _paired(runs: str, step: int) -> Column:
    """Hash of each run chained with the run that starts step words later (null past the end)."""
    return F.transform(runs, lambda h, i: F.xxhash64(h, F.get(F.col(runs), i + step)))


def _ranked(runs: str) -> Column:
    return F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _starts(ranked: str) -> Column:
    """Places of the runs whose hash occurs at least twice, ascending."""

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(F.col(ranked), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col(ranked), i + 1)["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(ranked, twice), lambda x: x["i"]))


def _covered(starts: str) -> Column:
    """Words inside windows that start at these places."""
    gaps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(F.col(starts), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def measured(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep columns plus MEASURES (long); no shuffle, no Python."""
    whole = docs.select(*keep, text_or_empty(text).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    first = whole.select(
        *keep,
        F.transform(F.array_remove(F.split("_text", SPACE_CLASS + "+"), ""), lambda w: F.xxhash64(w)).alias("_hashes"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        lines.alias("_lines"),
    )
    done = first.select(
        *keep,
        F.size("_hashes").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_hashes") >= WINDOW, F.col("_hashes")).alias("_runs"),
    )
    # Each step is a column of its own: a lambda that named an expression would evaluate it per element.
    for step in (1, 2, 4):
        done = done.withColumn("_runs", _paired("_runs", step))
    done = done.withColumn("_runs", F.slice("_runs", F.lit(1), F.size("_runs") - (WINDOW - 1)))
    done = done.withColumn("_runs", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), F.col("_runs")))
    done = done.withColumn("_runs", _ranked("_runs")).withColumn("_runs", _starts("_runs"))
    repeated = F.coalesce(_covered("_runs"), F.lit(0).cast("long")).alias("n_repeat_words")
    return done.select(*keep, *[m for m in MEASURES if m != "n_repeat_words"], repeated)


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, *keep: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep columns, measurements and fail_bits, each rule evaluated once.

    Naming the partition keeps Catalyst from copying all measurements into filters on the bits."""
    bits = F.when(F.spark_partition_id() >= 0, failure_bits(rules)).otherwise(F.lit(0).cast("long"))
    return measured(docs, *keep, text=text).withColumn("fail_bits", bits)


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's verdict and name."""
    return entries.withColumn("kept", passes(policy)).withColumn("policy", F.lit(f"{policy.name}@{policy.version}"))


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, and those that it alone rejects.

    Documents are first counted by their failure bits (2^rules rows at most)."""
    counts = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in RULES]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    inside = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return (
        counts.select(inside.alias("inside"), "n", rows)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("inside").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
            total(F.col("inside") == F.col("r.bit")).alias("rejected_alone"),
            total(F.col("inside").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
        )
    )


def filtered(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with exactly their own columns."""
    own = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{text}`").alias("_whole"))
    return ledger(wrapped, "_row", text="_whole").filter(passes(policy)).select("_row.*")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from inkstone.llm.common import documents

    entries = ledger(documents(spark, sf_dir), "doc_id")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(STRICT).alias("kept"), "fail_bits",
    )


_MEASURE_SQL = r"""
whole as (select doc_id, coalesce(text, '') as t from documents),
split_up as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from whole),
runs as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from split_up where len(w) >= 8),
keyed as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from runs),
twice as (select doc_id, i from keyed qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words from
  (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id),
measures as (select s.doc_id, len(w)::bigint as n_words,
  (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  len(regexp_extract_all(t, '\p{Lu}'))::bigint as n_upper,
  len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words
  from split_up s left join covered c on s.doc_id = c.doc_id)
"""


def _bits_sql() -> str:
    return " + ".join(f"case when {r.fails} then {1 << k} else 0 end" for k, r in enumerate(RULES))


OP5_SQL = f"""with {_MEASURE_SQL},
marked as (select *, ({_bits_sql()})::bigint as fail_bits from measures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {BASE.mask}) <> 0 as base_failed, (fail_bits & {STRICT.mask}) = 0 as kept, fail_bits from marked"""
