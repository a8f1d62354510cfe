import random
import re
from itertools import combinations

import numpy as np

from incrementa.llm import decontam
from incrementa.llm.decontam import SHORTEST, agreement, contamination, tokens, without_contaminated

from .conftest import sentence


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(text, items, window=13, share=0.8):
    """Every diagonal of every item; what spaced seeds may miss are windows without an unspoilt seed."""
    d, out = words(text), set()
    for i, t in items:
        q = words(t)
        w = min(window, len(q))
        if len(q) < SHORTEST:
            continue
        for a in range(len(d) - w + 1):
            for b in range(len(q) - w + 1):
                if sum(x == y for x, y in zip(d[a : a + w], q[b : b + w])) >= np.ceil(share * w):
                    out.add(i)
    return sorted(out)


def test_tokens():
    texts = ["Ab, c-d", "e", "", "é 1x", "x" * 9000 + " y"]
    raw = [t.encode() for t in texts]
    h, first = tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    again, _ = tokens(np.frombuffer(b"..AB", np.uint8), np.array([0, 4]))
    assert again[0] == h[0] and len(set(h.tolist())) == len(h)


def test_against_brute(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(11)
    items = [(i, sentence(rng, n)) for i, n in enumerate([40, 25, 13, 9, 6, 3, 1, 60])] + [(50, None), (51, "")]
    rows = [r for r in edge_rows if r[0] is not None and len(r[1] or "") < 5000]
    for k, (i, t) in enumerate(items[:6]):
        q = (t or "").split()
        swapped = [w if j % 9 else "swapped" for j, w in enumerate(q)]
        rows += [(1000 + k, sentence(rng, 20) + " " + t + " " + sentence(rng, 20)), (1100 + k, sentence(rng, 5) + " " + " ".join(swapped).upper() + ". " + sentence(rng, 5)), (1200 + k, " ".join(q[: len(q) // 2]))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_ids int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_ids) for r in contamination(docs, bench).collect())
    assert got == sorted((i, brute(t, items)) for i, t in rows)
    whole = sorted((r.doc_id, r.item_ids, r.spans) for r in contamination(docs, bench).collect())
    assert sorted((r.doc_id, r.item_ids, r.spans) for r in contamination(docs, bench, block_bytes=0).collect()) == whole
    kept = [i for i, found in got if not found]
    for most in (0, 1 << 20):
        clean = without_contaminated(docs, bench, block_bytes=most)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == kept
    assert contamination(no_docs, bench).collect() == []
    assert not any(r.contaminated for r in contamination(edge_docs, bench.limit(0)).collect())
    assert contamination(edge_docs, bench).count() == len(edge_rows)


def test_agreement():
    a = np.arange(20, dtype=np.uint64)
    b = a.copy()
    b[[2, 9, 15]] = 99
    assert agreement(a, b, 13, 0.8) == (3, 11) or agreement(a, b, 13, 0.8)[1] >= 11
    assert agreement(a, b + np.uint64(1), 13, 0.8) is None


def test_no_allowed_substitution_is_missed(spark):
    """Every pattern of substitutions that the threshold allows, in items of every length up to a window and one beyond."""
    rng = random.Random(3)
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(SHORTEST, 15)]
    rows, want = [], []
    for n, text in items:
        w = min(n, 13)
        for spoilt in combinations(range(w), int(w - np.ceil(0.8 * w))):
            q = [f"other{rng.randrange(10**9)}" if k in spoilt else x for k, x in enumerate(text.split())][:w]
            rows.append((len(rows), " ".join(["before", *q, "behind"])))
            want.append([n])
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 0):
        got = {r.doc_id: r.item_ids for r in contamination(docs, bench, block_bytes=most).collect()}
        assert len(rows) > 279 and [i for i, _ in rows if got[i] != want[i]] == []


def test_rows_are_judged_each(spark):
    """Rows without an id, with the same id and with id -1; items without an id."""
    rng = random.Random(5)
    items = [(1, sentence(rng, 30)), (None, "alpha beta gamma delta epsilon zeta eta theta"), (2, sentence(rng, 20))]
    rows = [(None, items[0][1]), (None, "nothing at all here"), (-1, items[1][1]), (7, "clean"), (7, items[0][1] + " " + items[1][1]), (7, items[2][1]), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(None, [1]), (None, []), (-1, [None]), (7, []), (7, [1, None]), (7, [2]), (8, [])], key=repr)
    for most in (1 << 20, 100, 0):
        assert sorted(((r.doc_id, r.item_ids) for r in contamination(docs, bench, block_bytes=most).collect()), key=repr) == want
        assert sorted((r.doc_id or 0, r.text or "") for r in without_contaminated(docs, bench, block_bytes=most).collect()) == [(0, "nothing at all here"), (7, "clean"), (8, "")]


def test_every_length_to_forty(spark):
    """Substitutions at random, at the threshold and beyond it, in items of up to forty tokens."""
    rng = random.Random(9)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(SHORTEST, 41)]
    rows = []
    for n, text in items:
        for _ in range(12):
            q = [f"o{rng.randrange(10**9)}" if rng.random() < 0.25 else x for x in text.split()]
            rows.append((len(rows), " ".join(["before", *q, "behind"])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, [items[i // 12]]) for i, t in rows}
    assert 30 < sum(map(bool, want.values())) < len(rows) - 30
    for most in (1 << 20, 0):
        assert {r.doc_id: r.item_ids for r in contamination(docs, bench, block_bytes=most).collect()} == want


def test_pairs_at_once_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 3, 4000).astype(np.uint64), rng.integers(0, 3, 4000).astype(np.uint64)
    run = rng.integers(-2, 60, 500)
    a, q, w = rng.integers(0, 3900, 500), rng.integers(0, 3900, 500), rng.integers(1, 14, 500)
    for places in (1 << 20, 50):
        monkeypatch.setattr(decontam, "PLACES", places)
        start, same = decontam.agreements(x, y, a, q, run, w, 0.6)
        for k in range(500):
            want = decontam.agreement(x[a[k] : a[k] + run[k]], y[q[k] : q[k] + run[k]], int(w[k]), 0.6) if run[k] > 0 else None
            assert (int(start[k]), int(same[k])) == (want or (-1, 0))
    assert (start >= 0).sum() > 50


def test_items_that_share_an_opening(spark):
    """Every document begins as every item does, and agrees with it there: 1,000 documents, 500 items."""
    import time

    opening = "read the following passage with care and then answer the question below in your own words"
    items = spark.createDataFrame([(k, f"{opening} item{k} " + " ".join(f"i{k}w{j}" for j in range(20))) for k in range(500)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{opening} text{k}" if k % 2 else f"plain text{k}") for k in range(2000)], "doc_id long, text string").repartition(8)
    began = time.time()
    assert sorted(r.doc_id for r in decontam.without_contaminated(docs, items).select("doc_id").collect()) == list(range(0, 2000, 2))
    assert time.time() - began < 60
