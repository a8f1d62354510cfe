"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on whole texts of a sample of labelled documents, bounded in rows. A text is
compressed with either, in blocks so that the dictionary counts along its whole length, and the
difference of the compressed sizes, normalised by the text's length, is calibrated to a probability by logistic
regression on the other half of the sample. The model depends on the rows alone, not on their order.

Edge cases: null text is empty; empty text gets the calibrated score of no difference; repeated rows
score alike; labels without both classes give the base rate; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import prepare, slices, text_views
from incrementa.llm.learn import fit_logistic, held_out, probability, training_sample

BLOCK, DICTIONARY, LEVEL = 1024, 65536, 3


class Compressors:
    """A compressor with the dictionary of good text, one with that of bad text, one without."""

    _made: dict[int, Compressors] = {}

    def __init__(self, good: bytes, bad: bytes) -> None:
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.each = [self._with(x, plain) for x in (good, bad)]

    @staticmethod
    def _with(raw: bytes, options: dict) -> zstandard.ZstdCompressor:
        if not raw:
            return zstandard.ZstdCompressor(**options)
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, **options)

    @classmethod
    def of(cls, good: bytes, bad: bytes) -> Compressors:
        key = hash((good, bad))
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(good, bad)
        return cls._made[key]

    def features(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text: the difference of its two compressed sizes over its length, positive where it is like good text."""
        raw = memoryview(body.tobytes())
        out = np.zeros(len(off) - 1)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if b > a:
                blocks = [raw[k : min(k + BLOCK, b)] for k in range(a, b, BLOCK)]
                good, bad = (sum(len(c.compress(x)) for x in blocks) for c in self.each)
                out[i] = (bad - good) / (b - a)
        return out


def train_dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[k : k + BLOCK] for t in texts for k in range(0, len(t), BLOCK) if len(t[k : k + BLOCK]) >= 8]
    if len(blocks) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray]:
    """(good dictionary, bad dictionary, calibration). Half of the sample makes dictionaries, half calibrates."""
    sample = training_sample(docs, labels, "quality").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    rows = sorted((r["doc_id"], r["label"], r["text"].encode()) for r in sample.where("half = 0").toLocalIterator())
    good, bad = (train_dictionary([t for _, y, t in rows if y == label]) for label in (1, 0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors.of(good, bad)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(c.features(*text_views(batch.column("text"))))], ["doc_id", "label", "x"])

    points = sample.where("half = 1").select("doc_id", "label", "text").mapInArrow(measured, "doc_id long, label int, x double").toPandas().sort_values("doc_id")
    return good, bad, fit_logistic(points[["x"]].to_numpy(float), points["label"].to_numpy(float))


def score_batches(batches: Iterator[pa.RecordBatch], good: bytes, bad: bytes, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    c = Compressors.of(good, bad)
    for whole in batches:
        for batch in slices(whole, "text"):
            x = c.features(*text_views(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(probability(x[:, None], weights))], ["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of good quality), predicted."""
    prepare(docs.sparkSession)
    good, bad, weights = fit_quality(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(lambda it: score_batches(it, good, bad, weights), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
