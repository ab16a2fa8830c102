"""The prefix trie against a plain version."""

import hashlib
import math
import re
import zlib

import pytest

from inkstone.llm import trie
from tests.llm.data import LONG, tables


def brute(rows: list[tuple], block=20, kept=4) -> list[tuple]:
    """rows (conv, turn, role, text)."""
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    said = {c: [t[3] for t in sorted(own)] for c, own in convs.items()}
    members, ended = {}, {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % kept
        whole = [*said.get(c - int(math.fmod(c, block)), [])[:h], *own[h:]]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ended.setdefault(tuple(whole), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(ended.get(node, []))))
        children = sum(len(n) == len(node) + 1 for n in below)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    return sorted((tuple(r) for r in trie.trie(trie.prefixes(*trie.rebuilt(trie.turns(df)))).select(*COLUMNS).collect()), key=str)


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_long_conversation_and_many_copies(spark, many_partitions):
    long = [(40, t, "user", f"word {t}") for t in range(150)] + [(41, t, "user", f"word {t}") for t in range(150)]
    copies = [(c, t, "user", ("hello there", "same", "end")[t]) for c in range(100, 260) for t in range(2 + c % 2)]
    others = [(c, t, ("user", "assistant")[t % 2], f"{c % 3} {t % 2}") for c in range(300, 340) for t in range(c % 6)]
    rows = long + copies + others
    assert found(spark, rows) == brute(rows)


def test_packed_pieces_and_hot_pointers(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(trie, "PACKED", 7)
    monkeypatch.setattr("inkstone.llm.common.HOT_KEYS", 10)  # half of the nodes' pointers are joined by broadcast
    rows = [(c, t, "user", ("first", "second", f"{c % 5}", "x y")[t]) for c in range(-60, 60) for t in range(1 + c % 4)]
    assert found(spark, rows) == brute(rows)


def test_query_on_odd_rows(spark, tmp_path):
    got = trie.op13_trie(spark, tables(spark, tmp_path / "odd")).select(*COLUMNS).collect()
    said = [(0, 0, "user", "a b"), (0, 1, None, None), (0, None, "system", LONG), (3, 0, "user", "a b"), (3, 0, "user", "a b"), (None, 0, "user", "lost"), (20, 5, "user", ""), (21, 0, "user", "x"), (-5, 1, "user", "y")]
    assert sorted((tuple(r) for r in got), key=str) == brute(said)
