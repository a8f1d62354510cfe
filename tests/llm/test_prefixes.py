"""The conversation trie against a brute-force version and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from incrementa.llm import prefixes
from incrementa.llm.prefixes import prefix_trie
from incrementa.llm.registry import op12_prefix_trie
from incrementa.llm.sql import OP12

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Node tuples of (conv_id, turn, role, text) rows."""
    own = {}
    for c, _, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        parents = {p[:-1] for p in members if p}
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(path))))
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children, sum(p not in parents for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, key string, depth int, n int").repartition(5)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def check(spark, rows):
    assert ordered(tuple(r) for r in prefix_trie(frame(spark, rows)).select(*NAMES).collect()) == ordered(brute(rows))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", ""])) for c in range(120) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", x) for c in range(200, 240) for t, x in enumerate("abcdefgh"[: 3 + c % 5])]
    check(spark, rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, None, None, None), (1, 2, "user", "late"), (1, 1, "user", "tie b"), (1, 1, "user", "tie a"), (5, 0, "user:", "x"), (6, 0, "user", ":x"), (7, 0, "", ""), (-3, 0, "user", "below zero"), (9, 0, "user", "\U0001f600" * 50000), (10, 0, "user", "a"), (14, 0, "user", "a")]
    # negative ids: families follow the remainder of SQL
    check(spark, [r for r in rows if r[0] is None or r[0] >= 0])
    assert prefix_trie(frame(spark, rows)).count() > 0


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


@pytest.mark.parametrize("chunk, piece", [(4, 8)])
def test_long_conversation_and_hot_turn(spark, monkeypatch, chunk, piece):
    """Chunks and pieces much smaller than a conversation and a node's ends; one conversation holds a third of all rows."""
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    monkeypatch.setattr(prefixes, "PIECE_BYTES", piece)
    rows = [(0, t, "user", f"t{t % 3}") for t in range(60)] + [(c, 0, "user", "hello") for c in range(1, 100)] + [(c, 1, "user", "x") for c in range(50, 70)]
    check(spark, rows)


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(NAMES)} FROM ({OP12})").fetchall()
    assert ordered(tuple(r) for r in op12_prefix_trie(spark, sf).select(*NAMES).collect()) == ordered(want)
