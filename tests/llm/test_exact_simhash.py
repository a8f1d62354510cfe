import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

from incrementa.llm.common import components, numpy_components
from incrementa.llm.exact import cuts, exact_groups
from incrementa.llm.simhash import close_pairs, exact_scheme, near_groups, shingle_hashes, similar_scheme, simhash_groups

#: the rolling hash of its last 32 bytes asks for a cut
CUT_AT_END = "hemqmxvtbdndfqpyoftzcvoyfulbztfsqqjulhvdcvwpgapdojcwdeqaywnidzvpxaebkaqpnpwjmuwt"


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        known = [x for x in same if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_against_brute(edge_docs, edge_rows):
    got = sorted((tuple(r) for r in exact_groups(edge_docs).collect()), key=repr)
    assert got == brute_groups(edge_rows)


def test_exact_with_clashing_hashes(spark, edge_docs, edge_rows):
    got = sorted((tuple(r) for r in exact_groups(edge_docs, hash_bits=1).collect()), key=repr)
    assert got == brute_groups(edge_rows)
    rows = [(i, t) for i in (5, 5, None, -1) for t in ("abc", "abd", "xyz", "x" * 40000, "y" * 40000, "x" * 20000 + "y" * 20000)]
    got = sorted((tuple(r) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), hash_bits=1).collect()), key=repr)
    assert got == brute_groups(rows)


def test_exact_where_the_last_byte_is_a_cut(spark):
    for after in ([], [(50, ""), (51, None)]):  # last in its batch, or followed by empty texts alone
        rows = [(i, t) for i, t in enumerate([CUT_AT_END, "other", CUT_AT_END + "more", CUT_AT_END])] + after
        for bits in (64, 1):
            got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), hash_bits=bits).collect()
            assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows)


def test_cuts_do_not_depend_on_neighbours():
    rng = np.random.default_rng(9)
    texts = [rng.integers(97, 123, n, dtype=np.uint8) for n in rng.integers(0, 9000, 300).tolist()] + [np.frombuffer(CUT_AT_END.encode(), np.uint8)]
    size, alone = np.array([len(t) for t in texts]), []
    off = np.concatenate([[0], np.cumsum(size)])
    for k, t in enumerate(texts):
        starts, doc = cuts(t, np.array([0, len(t)]))
        assert starts[0] == 0 and starts[-1] == len(t) and not doc.any()
        alone += [(k, a) for a in starts[:-1].tolist()]
    starts, doc = cuts(np.concatenate(texts), off)
    assert len(alone) > 600 and list(zip(doc.tolist(), (starts[:-1] - off[doc]).tolist())) == alone and starts[-1] == off[-1]


def test_empty_tables(no_docs):
    assert exact_groups(no_docs).collect() == []
    assert simhash_groups(no_docs).collect() == []


def brute_print(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [words[k : k + width] for k in range(len(words) - width + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for k in range(len(ids)):
        low[find(k)].append(ids[k])
    return [min((x for x in low[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_simhash_against_brute(edge_docs, edge_rows):
    prints = [brute_print(t) for _, t in edge_rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(edge_rows, prints, brute_components(prints, [i for i, _ in edge_rows]))), key=repr)
    assert sorted((tuple(r) for r in simhash_groups(edge_docs).collect()), key=repr) == want


def test_links_with_split_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 2), dtype=np.uint64), axis=1) for c in centre]))
    ids = list(range(len(prints)))
    monkeypatch.setattr("incrementa.llm.simhash.TILE", 16)
    frame = spark.createDataFrame([(i, int(np.int64(p.view(np.int64)))) for i, p in zip(ids, prints)], "doc_id long, f0 long")
    got = dict((r.doc_id, r.component_id) for r in near_groups(frame, exact_scheme()).collect())
    assert [got[i] for i in ids] == brute_components([int(p) for p in prints], ids)


def test_close_pairs_skips_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 64, 700, dtype=np.uint64)
    i, j = close_pairs(x[:, None], x[:, None], 2)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(700) for b in range(700) if int(x[a] ^ x[b]).bit_count() <= 2}


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (5, 100), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in (*range(1, 41), 90, 100)) and got[201] == 200
    assert numpy_components(5, np.array([0, 3]), np.array([4, 4])).tolist() == [0, 1, 2, 0, 0]


def test_similar_scheme_meets_the_threshold(spark):
    import random

    rng, rows = random.Random(12), []
    for g in range(60):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(80, 600))]
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 4):
            edited = [w if rng.random() > 0.01 * c else "edited" + str(rng.random()) for w in words]
            rows.append((10 * g + c, " ".join(edited)))
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), similar_scheme()).collect()}
    sets = {i: set(shingle_hashes(t.encode(), 5)) for i, t in rows}
    sure = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.88 * len(sets[i] | sets[j])]
    assert len(sure) > 40 and sum(got[i] == got[j] for i, j in sure) >= 0.97 * len(sure)
    assert all(got[i] // 10 == i // 10 for i in got)


def test_similar_links_are_exact(spark):
    import random

    rng, rows = random.Random(21), []
    for g in range(160):
        n = rng.choice([9, 14, 30, 90, 300])
        words = [f"w{rng.randrange(9000)}" for _ in range(n)]
        at = rng.randint(1, n - 1)
        # every similarity from about 0.65 to 0.95, by words added behind, before or in the middle
        more = [f"more{rng.random()}" for _ in range(max(1, round(n * rng.uniform(0.02, 0.5))))]
        other = rng.choice([words + more, more + words, words[:at] + more + words[at:]])
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    rows += [(1000, "tail " + "same words over and over " * 40), (1001, "same words over and over " * 4 + "tail")]
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), similar_scheme()).collect()}
    sets = {i: set(shingle_hashes(t.encode(), 5)) for i, t in rows}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in sets if i % 2 == 0}
    near = [x for x in share.values() if 0.8 <= x < 0.85]
    far = [x for x in share.values() if 0.7 <= x < 0.8]
    assert len(near) > 8 and len(far) > 8
    assert {i: got[i + 1] == got[i] for i in share} == {i: x >= 0.8 for i, x in share.items()}
    assert all(got[i] in (i, i - i % 2) for i in got)
