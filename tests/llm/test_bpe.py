import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkstone.llm import bpe as B

LIBRARY = Tokenizer.from_file(B.public_path())
LIBRARY.no_padding()
LIBRARY.no_truncation()
OWN = B.loaded(B.public_path())


def agrees(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    agrees(text)


def test_awkward_texts():
    rng = random.Random(3)
    letters = "aAbBéÉßΣσςİıǅ'’sStT0123 \t\n\x1c\x85 　!?.,-_—中文日本क́ëİ😀ﬁ①\x00\x7f"
    for _ in range(2000):
        agrees("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))))
    for text in ("", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "it's WE'LL they've", "A" * 3000, "ab" * 5000, "İstanbul ΣΑΣ"):
        agrees(text)


def test_tree_gives_leftmost_lowest_merge():
    rng = random.Random(9)
    for _ in range(1000):
        pairs = rng.sample([(x, y) for x in range(6) for y in range(6)], 10)
        results = [rng.randrange(6) for _ in pairs]
        pieces = [rng.randrange(2) for _ in range(rng.randint(0, 25))]
        slow = list(pieces)
        while True:
            best = min(((pairs.index(p), i) for i, p in enumerate(zip(slow, slow[1:], strict=False)) if p in pairs), default=None)
            if best is None:
                break
            slow[best[1] : best[1] + 2] = [results[best[0]]]
        assert B.merge_pieces(pieces, {a * B.PIECES + b: k for k, (a, b) in enumerate(pairs)}, results) == slow


def test_frames(spark):
    docs = spark.createDataFrame([(1, "The cat"), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in B.encoded(docs, B.public_path()).collect()}
    assert out[1]["ids"] == LIBRARY.encode("The cat", add_special_tokens=False).ids and out[2]["ids"] == [] and out[3]["decoded"] == ""
