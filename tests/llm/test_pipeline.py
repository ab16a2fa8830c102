"""The whole pipeline against a plain version, and the values of odd rows in every query."""

import re

import duckdb
import pytest

import corpus_pipeline
from inkstone.llm import bpe, pii, quality, registry
from tests.llm.data import TEXTS, tables
from tests.llm.test_simhash import five_word_sets, near, roots

_ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def decontaminated(text, items, most=0.5):
    """text less the words of every occurrence of an item's window (from the first to the last byte of a stretch), or None."""
    raw, places = text.encode(), [m.span() for m in _ITEM_WORD.finditer(folded(text))]
    words = [folded(text)[a:b] for a, b in places]
    hit = [False] * len(words)
    for item in items:
        own = _ITEM_WORD.findall(folded(item))
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if windows and tuple(words[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
    if sum(hit) > most * len(words):
        return None
    out, at, i = [], 0, 0
    while i < len(words):
        if hit[i]:
            j = i
            while j + 1 < len(words) and hit[j + 1]:
                j += 1
            out.append(raw[at : places[i][0]])
            at, i = places[j][1], j
        i += 1
    return b"".join([*out, raw[at:]]).decode()


def test_run_equals_a_plain_version(spark):
    tokenizers = pytest.importorskip("tokenizers")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    good = {r[0] for r in con.sql(f"select doc_id from ({quality.OP5_SQL}) where kept").fetchall()}
    docs = sorted((i, t) for i, t in con.sql("select doc_id, text from documents").fetchall() if i in good)
    sets = five_word_sets([t for _, t in docs])
    docs = [docs[k] for k, r in enumerate(roots(sets, near)) if r == k]
    items = [r[0] for r in con.sql(f"select text from '{d}/benchmark.parquet'").fetchall()]
    clean = [(i, decontaminated(t, items)) for i, t in docs]
    replaced = pii.Surrogates(pii.EXAMPLE_KEY).replaced
    library = tokenizers.Tokenizer.from_file(bpe.public_path())
    want = {i: library.encode(replaced(t)[0], add_special_tokens=False).ids for i, t in clean if t is not None}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want and 0 < len(got) < 200


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tables(spark, tmp_path_factory.mktemp("odd"))
    return {n: q(spark, d).collect() for n, q in registry.queries().items()}


#: Ids of rows whose text is null, empty or blank, in TEXTS.
EMPTY = (0, 1, 2)


@pytest.mark.parametrize(
    ("name", "column", "value"),
    [
        ("op3_decontaminate", "n_words", 0), ("op3_decontaminate", "contaminated", False), ("op4_license", "license", None), ("op5_quality", "n_words", 0), ("op5_quality", "kept", False),
        ("op6_sharding", "law", "bytes"), ("op7_simhash", "fingerprint", "0" * 16), ("op7_simhash", "component_id", 0), ("op8_ctw", "n_tokens", 1), ("op9_bpe", "n_tokens", 0), ("op2_pii", "n_entities", 0),
    ],
)
def test_rows_without_words(odd, name, column, value):
    assert [r[column] for r in odd[name] if r["doc_id"] in EMPTY] == [value] * 3


def test_values_of_odd_rows(odd):
    by = {n: {r["doc_id"]: r for r in rows if "doc_id" in r} for n, rows in odd.items()}
    texts = {i: t for i, t in TEXTS}
    assert [by["op2_pii"][i]["text"] for i in EMPTY] == [None, "", " \t\n"] and by["op2_pii"][6]["n_entities"] == 2
    assert by["op6_sharding"][0]["size"] == by["op6_sharding"][1]["size"] == 1 and by["op6_sharding"][5]["size"] == len(texts[5]) + 1
    assert len({(r["shard"], r["slot"]) for r in odd["op6_sharding"]}) == len(TEXTS)
    assert by["op5_quality"][5]["n_words"] == 60_000 and by["op5_quality"][5]["n_repeat_words"] == 60_000
    assert by["op3_decontaminate"][6]["n_hit"] == 14 and by["op3_decontaminate"][4]["n_items"] == 1
    assert by["op7_simhash"][3]["component_id"] == by["op7_simhash"][4]["component_id"] == 3
    assert by["op8_ctw"][5]["n_tokens"] == 60_001
    assert len({r["score"] for r in odd["op1_toxicity"] if r["doc_id"] in EMPTY}) == 1
    for name in ("op1_toxicity", "op8_ctw"):  # repeated rows get equal results
        assert len({r["score"] for r in odd[name] if r["doc_id"] == 4}) == 1
    assert [r["doc_id"] for r in odd["pipeline"]] == [6]
