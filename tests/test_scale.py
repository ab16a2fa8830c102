"""Work that must not grow faster than the input: evaluated once, and dealt to all cores."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import compose, dedup, vector
from inkstone.plans import catalog
from inkstone.session import spread

SF = "/root/testdata/sf0.001"


def test_common_letters_of_many_pairs():
    """many pairs at a time give what one at a time gives, over one word and more."""
    r = random.Random(3)
    for letters, n in (("ab", 250), ("abcdé ", 130), ("xyz", 64), ("a", 65)):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(1, n))) for _ in range(12)]
        others = ["".join(r.choice(letters + "q\U0001f600") for _ in range(r.randint(1, 300))) for _ in range(15)]
        a, b = np.divmod(np.arange(12 * 15), 15)
        found = dedup.common_letters(dedup.letter_codes(texts), dedup.letter_codes(others), a, b)
        assert found.tolist() == [dedup.Common(texts[i]).letters(others[j]) for i, j in zip(a, b, strict=True)]


def test_one_row_group_is_spread(spark, tmp_path):
    """A file of one row group is read by one task; spread deals its rows to more, and keeps them all."""
    path = str(tmp_path / "one")
    spark.range(4000).coalesce(1).write.parquet(path)
    sizes = [r["count"] for r in spread(spark.read.parquet(path), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 8 and max(sizes) < 1000


def test_contents_reads_its_rows_once(spark):
    """classified rows are costly, so the table of contents may evaluate each once."""
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def classified(i: pd.Series) -> pd.Series:
        read.add(len(i))
        return i.map(lambda x: ("Development", "Regional News")[x % 2])

    rows = spark.range(60).select("id", F.concat(F.lit("t"), "id").alias("title"), classified("id").alias("category"))
    assert compose.contents(rows).count() == 60
    assert read.value == 60


def test_dates_are_searched_once(spark):
    """one search for dates and one for years in a text."""
    plan = catalog.QUERIES["numbers_and_dates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4


def test_white_space_runs(spark):
    """The faster pattern leaves what the plain one leaves."""
    r = random.Random(5)
    odd = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "é", "語", "-", " ", "a"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 30))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace("t", T.SPACE + "+", " "))
    assert rows.filter(T.squeezed(F.col("t")) != plain).count() == 0


def test_vectors_are_sent_a_few_at_a_time():
    """what a step holds does not follow the size of a batch."""
    batch = pd.DataFrame({"id": np.arange(5000), "embedding": [np.ones(2)] * 5000})
    sizes = [len(b) for b in vector._slices(iter([batch]))]
    assert sum(sizes) == 5000 and max(sizes) <= 1024


def test_many_questions_in_slices(spark):
    """the nearest rows are the same when a list comes in many slices."""
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(2600, 4)), 1)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, embedding array<double>")
    found = vector.top_k(rows.filter("id % 100 = 0"), rows, 3).toPandas()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for q, own in found.groupby("query_id"):
        s = np.round(unit @ unit[q], 9)
        assert own.sort_values("place")["id"].tolist() == np.lexsort((np.arange(len(v)), -s))[:3].tolist()
