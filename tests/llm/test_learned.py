import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from incrementa.llm import quality, toxicity
from incrementa.llm.learn import training_sample
from incrementa.llm.quality import fit_quality, score_quality
from incrementa.llm.toxicity import Matcher, fit_toxicity, fold, score_toxicity

from .conftest import sentence


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = sentence(rng, rng.randint(20, 200)).split()
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blargface", "Bl4rgfaces", "zorkhead", "zоrkheads"]))  # one with a Cyrillic o
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(good), int(toxic)))
    docs = spark.createDataFrame([(r[0], r[1], "q") for r in rows] + [(9001, None, ""), (9002, "", ""), (9003, "x" * 200000, ""), (9003, "x" * 200000, "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(r[0], r[2], r[3], "z") for r in rows] + [(0, 0, 1, "z"), (None, 1, 1, "z"), (7777, None, None, "z")], "doc_id long, quality int, toxic int, text string")
    return docs, labels, rows


@pytest.mark.parametrize("scorer,column", [(score_toxicity, 3), (score_quality, 2)])
def test_held_out_accuracy(labelled, scorer, column):
    docs, labels, rows = labelled
    got = scorer(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {r[0]: r[column] for r in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97


@pytest.mark.parametrize("scorer", [score_toxicity, score_quality])
def test_without_labels_or_documents(labelled, spark, no_docs, scorer):
    docs, labels, _ = labelled
    assert len({r.score for r in scorer(docs, labels.limit(0)).collect()}) == 1
    assert scorer(no_docs, labels).collect() == []


def test_folding_and_exceptions():
    assert fold("ＴＲ4SH, Íd1ot! m0r​on c@t $5 naïve") == " trash idiot moron cat s naive "
    m = Matcher({"trash": 2.0, "trashy": 3.0, "scum": 1.0}, ("trash can", "pond scum"))
    text = fold("A tr@sh can, trashy talk; pond scum is no scum. untrash")
    assert [w for _, w in m.matches(text)] == [3.0, 1.0]


def test_lexicon_has_the_stems(labelled):
    docs, labels, _ = labelled
    lexicon, _, _ = fit_toxicity(docs, labels)
    assert any("blargface".startswith(t) for t in lexicon) and any("zorkhead".startswith(t) for t in lexicon)


def logistic(x, w):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, w)) + w[-1]))))


def train_rows(docs, labels, column):
    """Training texts with labels, from the definitions."""
    label = {}
    for r in labels.collect():
        y = r[column]
        if r.doc_id is not None and y in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            label[r.doc_id] = max(y, label.get(r.doc_id, 0))
    texts = {}
    for r in docs.collect():
        texts[r.doc_id] = min(texts.get(r.doc_id, r.text or ""), r.text or "")
    return {i: (texts[i], y) for i, y in label.items() if i in texts}


def brute_matches(folded, lexicon, exceptions):
    found, at = {}, 0
    for word in folded.split():
        at = folded.index(" " + word + " ", at)
        terms = [t for t in lexicon if word.startswith(t)]
        if terms:
            found[at] = (word, lexicon[max(terms, key=len)])
        at += len(word)
    for phrase in exceptions:
        p, k = fold(phrase), -1
        while (k := folded.find(p, k + 1)) >= 0:
            for a in [a for a in found if k <= a < k + len(p) - 1]:
                del found[a]
    return found


def brute_lexicon(rows):
    stems = lambda t: {w[:k] for w in fold(t).split() for k in range(4, min(len(w), 9) + 1)}
    n = Counter(y for _, y in rows.values())
    a, b = (Counter(s for t, y in rows.values() if y == label for s in stems(t)) for label in (1, 0))
    ratio = {s: (a[s] + 0.5) / (n[1] + 1) / ((b[s] + 0.5) / (n[0] + 1)) for s in a}
    likely = {s: math.log(r) for s, r in ratio.items() if a[s] >= max(3, 0.02 * n[1]) and r >= 20}
    kept = {s: w for s, w in likely.items() if not any(s[:k] in likely and likely[s[:k]] >= w - 1 for k in range(4, len(s)))}
    return kept


def test_toxicity_against_brute(labelled):
    docs, labels, _ = labelled
    lexicon, exceptions, w = fit_toxicity(docs, labels)
    assert lexicon == pytest.approx(brute_lexicon(train_rows(docs, labels, "toxic")))
    got = {(r.doc_id, r.score, r.predicted) for r in score_toxicity(docs, labels).collect()}
    want = set()
    for r in docs.collect():
        folded = fold(r.text or "")
        total = sum(x for _, x in brute_matches(folded, lexicon, exceptions).values())
        x = [math.log1p(total), math.log1p(1000 * total / max(1, len(folded.split()))), 1.0] if total else [0.0] * 3
        want.add((r.doc_id, logistic(x, w)))
    assert sorted((i, round(s, 9)) for i, s, _ in got) == sorted((i, round(s, 9)) for i, s in want)
    assert all(p == (s >= 0.3) for _, s, p in got)


def test_quality_against_brute(labelled):
    docs, labels, _ = labelled
    good, bad, w = fit_quality(docs, labels)
    each = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        size = [sum(len(c.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024)) for c in each]
        want.append((r.doc_id, logistic([(size[1] - size[0]) / len(raw) if raw else 0.0], w)))
    got = [(r.doc_id, r.score) for r in score_quality(docs, labels).collect()]
    assert sorted((i, round(s, 9)) for i, s in got) == sorted((i, round(s, 9)) for i, s in want)


def test_models_do_not_depend_on_partitions(labelled, monkeypatch):
    docs, labels, _ = labelled
    for module in (toxicity, quality):  # a bound that bites
        monkeypatch.setattr(module, "training_sample", lambda d, l, c: training_sample(d, l, c, 60))
    for fit in (fit_toxicity, fit_quality):
        one, two = (fit(docs.repartition(n), labels.repartition(n)) for n in (1, 7))
        assert one[:2] == two[:2] and np.array_equal(one[2], two[2])
    rows = training_sample(docs, labels, "toxic", 60).collect()
    assert Counter(r.label for r in rows) == {0: 60, 1: 60} and len({r.doc_id for r in rows}) == 120


def test_exceptions_are_learned_and_many_matches_are_quick(spark):
    import time

    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = sentence(rng, 30).split()
        words[9:9] = ["blargface"] if i % 4 == 0 else ["blargface", "museum"] if i % 31 == 0 else []
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic"), spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("text")
    lexicon, exceptions, _ = fit_toxicity(docs, labels)
    assert "blargface museum" in exceptions
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.98 * len(rows)
    begun, m = time.time(), Matcher({"blarg": 2.0}, ("blarg can",))
    assert len(m.matches(fold("blarg can blarg " * 40000))) == 40000 and time.time() - begun < 5
