"""Every query over odd tables and over empty ones."""

import pytest

from inkstone.llm import registry
from tests.llm.data import TEXTS, tables

NAMES = sorted(registry.queries())
#: op11: three distinct queries (0, 50, -50) of five rows each; op12: the seven sound vectors; op13: the nodes that test_trie counts.
ROWS = {n: len(TEXTS) for n in NAMES if n not in ("pipeline", "op13_trie")} | {"op10_warc": 7, "op11_topk": 15, "op12_codes": 7}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    rows = registry.queries()[name](spark, odd).collect()
    assert len(rows) == ROWS.get(name, len(rows))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).collect() == []


def test_stages_keep_columns(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= docs.count()
