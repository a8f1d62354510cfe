import hashlib
import random

import numpy as np

from incrementa.llm import repeats
from incrementa.llm.repeats import big_endian, common_prefixes, least_owners, suffix_order, without_repeats

from .conftest import sentence


def brute_row(row, rows, n=50):
    """(doc_id, bytes, removed, spans, digest of the rest) of one row among all."""
    return dict_of_windows(rows, n)(row)


def dict_of_windows(rows, n=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - n + 1):
                s = b[k : k + n]
                least[s] = min(least.get(s, i), i)

    def judged(row):
        i, b = row[0], (row[1] or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - n + 1):
                if least[b[k : k + n]] < i:
                    gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        return (i if i is not None else -1, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())

    return judged


def brute(rows):
    judged = dict_of_windows(rows)
    return sorted(judged(row) for row in rows)


def test_against_brute(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(21)
    rows = [r for r in edge_rows if len(r[1] or "") < 50000]
    shared = [sentence(rng, 30) for _ in range(4)]
    rows += [(900 + i, sentence(rng, 10) + rng.choice(shared)[rng.randint(0, 20) :] + sentence(rng, rng.randint(0, 60)) + rng.choice(shared)) for i in range(120)]
    rows += [(1200 + i, "ab" * rng.randint(10, 60)) for i in range(12)] + [(1300, "x" * 49), (1301, "x" * 50), (1302, "x" * 51), (1303, "é" * 25 + "y"), (1304, "y" + "é" * 25)]
    docs = spark.createDataFrame([(i, t, 5, "b") for i, t in rows], "doc_id long, text string, shard int, bucket string")
    for size in (1 << 20, 9000):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(docs, size).collect())
        assert got == brute(rows)
    assert without_repeats(no_docs).collect() == []
    assert without_repeats(edge_docs).count() == len(edge_rows)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(4)
    for alphabet in (2, 4, 255):
        text = np.concatenate([np.tile(rng.integers(0, alphabet, 60).astype(np.uint8), 20), rng.integers(0, alphabet, 900).astype(np.uint8), np.zeros(70, np.uint8)])
        start = np.flatnonzero(rng.random(len(text) - 49) < 0.8)
        words = big_endian(text)
        order = suffix_order(text, start, words)
        window = [text[s : s + 50].tobytes() for s in range(len(text) - 49)]
        assert order.tolist() == sorted(start.tolist(), key=lambda s: (window[s], s))
        prefix = common_prefixes(text, order, words).tolist()
        for a, b, n in zip(order.tolist(), order.tolist()[1:], prefix[1:]):
            assert min(n, 50) == next((k for k in range(50) if window[a][k] != window[b][k]), 50)


def test_least_owners():
    rng = np.random.default_rng(5)
    lists = []
    for _ in range(60):
        key = np.sort(np.array([bytes(x) for x in rng.integers(0, 2, (int(rng.integers(1, 400)), 9), np.uint8)], "S50"))
        lists.append((key, rng.integers(-5, 10**6, len(key))))
    least = {}
    for key, who in lists:
        for k, w in zip(key.tolist(), who.tolist()):
            least[k] = min(least.get(k, w), w)
    for repeats.FEW in (1, 300, 4096):
        assert least_owners(lists).tolist() == [least[k] for key, _ in lists for k in key.tolist()]


def test_null_beside_minus_one(spark):
    shared = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(-1, shared), (5, "before " + shared), (None, shared + " after"), (5, shared + "again"), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 20, 40):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(docs, size).collect())
        expect = sorted((i is not None, i or 0, *r[1:]) for (i, _), r in ((row, brute_row(row, rows)) for row in rows))
        assert got == expect
