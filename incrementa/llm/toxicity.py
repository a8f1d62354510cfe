"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, undoes look-alike letters, diacritics and full-width forms by table, and
digit or sign substitutions inside words; everything else that is no letter becomes a space. The
lexicon's terms are word beginnings learned from a bounded sample of labelled texts: those far
more frequent in toxic than in clean texts, the shortest that does it standing for its longer
forms. A match inside an exception phrase does not count; exceptions are a short list and the pairs of
words, one of them matched, that the sample's clean texts use and its toxic texts do not. Weights of
matches, as a sum and normalised by length in words, are calibrated to a probability by logistic regression.
The model depends on the rows alone, not on their order.

Edge cases: null text is empty; a text without matches, the empty one included, gets the
calibrated score of no evidence; repeated rows score alike; labels without both classes give the
base rate; without a labelled row every score is next to 0; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incrementa.llm.common import prepare
from incrementa.llm.learn import fit_logistic, held_out, probability, training_sample

#: fixed values: letters of other scripts that look like Latin ones
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнαοερτνικυω", "aeopcyxijsdhlkmtbhaoeptvikuw", strict=True))
#: fixed values: digits and signs written for letters
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: fixed values: phrases in which a term means no harm
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "rodeo clown", "sore loser board", "pond scum", "soap scum", "scum line", "stupidly simple")
LONGEST_STEM, SHORTEST_STEM, MOST_TERMS = 9, 4, 400
LEAST_RATIO = 20.0
#: learned exceptions, at most; clean texts that have to use one
MOST_EXCEPTIONS, LEAST_USES = 200, 3
SCORE = "__toxicity"

_SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")


#: log odds of a score that rejects nothing
UNLIKELY = -30.0


def _table() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    for code in [*range(0xA0, 0x250), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        table[code] = plain[0] if plain[0].isascii() and plain[0].isalnum() else chr(code) if chr(code).isalpha() else " "
    table |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    return table | {c: "" for c in (0x200B, 0x200C, 0x200D, 0xAD)}


_FOLD = _table()


def fold(text: str) -> str:
    """Words of folded letters, a single space before, between and after them."""
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text.lower())
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def stems(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1)]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word beginning."""
    counts: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts.update({(s, label) for w in set(fold(text or "").split()) for s in stems(w)})
    rows = list(counts.items())
    yield pa.record_batch([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["term", "label", "n"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Word beginnings with their log-odds weights."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    counted = sample.select("text", "label").mapInArrow(count_terms, "term string, label int, n long")
    each = counted.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    each = each.withColumn("ratio", (F.col("a") + 0.5) / (toxic + 1) / ((F.col("b") + 0.5) / (clean + 1)))
    likely = each.where((F.col("a") >= max(3, 0.02 * toxic)) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("a"), F.desc("ratio"), F.length("term"), "term").limit(20 * MOST_TERMS)
    found: dict[str, tuple[float, int]] = {r["term"]: (float(np.log(r["ratio"])), r["a"]) for r in likely.collect()}
    kept = {}
    for term, (weight, n) in found.items():
        shorter = [found[s] for s in stems(term)[:-1] if s in found]
        # a longer form adds nothing where a shorter one is as telling
        if not any(w >= weight - 1.0 for w, _ in shorter):
            kept[term] = (n, weight)
    best = sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:MOST_TERMS]
    return {term: weight for term, (_, weight) in best}


class Matcher:
    """One automaton over terms at word beginnings, one over exception phrases."""

    _made: dict[tuple, Matcher] = {}

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> None:
        self.terms = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.terms.add_word(" " + term, (len(term) + 1, weight))
        self.phrases = ahocorasick.Automaton()
        for phrase in exceptions:
            self.phrases.add_word(fold(phrase), len(fold(phrase)))
        self.terms.make_automaton()
        self.phrases.make_automaton()

    @classmethod
    def of(cls, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Matcher:
        key = (tuple(lexicon.items()), exceptions)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(lexicon, exceptions)
        return cls._made[key]

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each word that begins with a term, the longest term counting, outside exception phrases."""
        best: dict[int, float] = {}
        if len(self.terms):
            for end, (size, weight) in self.terms.iter(folded):
                best[end - size + 1] = weight  # at one start longer terms end later
        if best and len(self.phrases):
            starts = sorted(best)
            for end, size in self.phrases.iter(folded):
                for at in starts[bisect_left(starts, end - size + 1) : bisect_left(starts, end)]:
                    best.pop(at, None)
        return list(best.items())

    def pairs(self, folded: str) -> set[str]:
        """Pairs of neighbouring words of which one begins with a term."""
        out = set()
        for at, _ in self.matches(folded):
            end = folded.index(" ", at + 1)
            if at:
                out.add(folded[folded.rindex(" ", 0, at) + 1 : end])
            if end + 1 < len(folded):
                out.add(folded[at + 1 : folded.index(" ", end + 1)])
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: log of the summed weight, log of that per thousand words, whether any."""
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            folded = fold(text or "")
            if total := sum(w for _, w in self.matches(folded)):
                out[i] = np.log1p(total), np.log1p(1000 * total / max(1, folded.count(" ") - 1)), 1
        return out


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], given: tuple[str, ...]) -> tuple[str, ...]:
    """``given`` phrases and the commonest pairs of words around a match that several clean texts use and no toxic one does."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = Matcher.of(lexicon, given), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts.update((pair, label) for pair in m.pairs(fold(text or "")))
        rows = list(counts.items())
        yield pa.record_batch([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["phrase", "label", "n"])

    if not lexicon:
        return given
    each = sample.select("text", "label").mapInArrow(counted, "phrase string, label int, n long").groupBy("phrase")
    each = each.agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    best = each.where((F.col("toxic") == 0) & (F.col("clean") >= LEAST_USES)).orderBy(F.desc("clean"), "phrase").limit(MOST_EXCEPTIONS)
    return (*given, *(r["phrase"] for r in best.collect()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[dict[str, float], tuple[str, ...], np.ndarray]:
    """(lexicon, exception phrases, calibration) from the training sample."""
    sample = training_sample(docs, labels, "toxic")
    lexicon = learn_lexicon(sample)
    exceptions = learn_exceptions(sample, lexicon, exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher.of(lexicon, exceptions)
        for batch in batches:
            x = m.features(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), *(pa.array(x[:, k]) for k in range(3))], ["doc_id", "label", "a", "b", "c"])

    points = sample.select("doc_id", "label", "text").mapInArrow(measured, "doc_id long, label int, a double, b double, c double").toPandas().sort_values("doc_id")
    weights = fit_logistic(points[["a", "b", "c"]].to_numpy(float), points["label"].to_numpy(float))
    if not len(points):
        weights = np.append(weights[:-1], UNLIKELY)
    return lexicon, exceptions, weights


def score_batches(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], weights: np.ndarray, exceptions: tuple[str, ...], dropped: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The batches' columns but ``dropped``, and SCORE."""
    m = Matcher.of(lexicon, exceptions)
    for batch in batches:
        x = m.features(batch.column("text").to_pylist())
        names = [c for c in batch.schema.names if c not in dropped]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(probability(x, weights))], [*names, SCORE])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of being toxic), predicted."""
    prepare(docs.sparkSession)
    lexicon, exceptions, weights = fit_toxicity(docs, labels, exceptions)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(lambda it: score_batches(it, lexicon, weights, exceptions, ("text",)), f"doc_id long, {SCORE} double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """Rows of ``docs``, all columns, that score under ``threshold``; texts are not shuffled."""
    prepare(docs.sparkSession)
    lexicon, exceptions, weights = fit_toxicity(docs, labels, exceptions)
    schema = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())])
    return docs.mapInArrow(lambda it: score_batches(it, lexicon, weights, exceptions), schema).where(F.col(SCORE) < threshold).drop(SCORE)
