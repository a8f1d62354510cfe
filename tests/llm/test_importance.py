"""Importance resampling against a brute-force version and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from incrementa.llm.importance import resample
from incrementa.llm.registry import op11_importance
from incrementa.llm.sql import OP11

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, target, buckets, width, percent, least_words):
    """A list of (doc_id, n_words, n_features, weight, score, rank)."""

    def split(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(words) - k + 1)]

    held = [(i, *split(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in split(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for i, words, f in held:
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[b] for b in f)
        out.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None])
    drawn = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for place, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[5] = place
    return [tuple(r) for r in out]


def got(frame):
    return [tuple(None if x is None or x != x else int(x) for x in r) for r in frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").toPandas().itertuples(index=False, name=None)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("width, percent", [(1, 10), (3, 50)])
def test_against_brute_force(spark, edge_docs, edge_rows, width, percent):
    target = ["river stone light", "green river", None, "", "东京 naïve"]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = got(resample(edge_docs, aim, buckets=500, width=width, percent=percent))
    want = brute(edge_rows, target, 500, width, percent, 20)
    # rows that are alike in id and score may change places
    assert ordered(r[:5] for r in found) == ordered(r[:5] for r in want)
    assert sorted(r[5] for r in found if r[5]) == sorted(r[5] for r in want if r[5])
    assert {r[4] for r in found if r[5]} == {r[4] for r in want if r[5]}


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(resample(no_docs, none)) == []
    assert len(got(resample(edge_docs, none))) == edge_docs.count()
    assert got(resample(no_docs, edge_docs)) == []


def test_one_word_in_every_document(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('common ', repeat(concat('w', id % 50, ' '), 30)) AS text").repartition(16)
    aim = spark.createDataFrame([("common w7 w7",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ordered(got(resample(docs, aim, buckets=1000))) == ordered(brute(rows, ["common w7 w7"], 1000, 1, 10, 20))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({OP11}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in op11_importance(spark, sf).select(*names).orderBy("doc_id").collect()] == want
