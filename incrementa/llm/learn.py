"""What the learned operators share: the training fold, a bounded labelled sample, logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import settle

#: labelled documents a class that models are fitted on, at most; a documented bound, as the sample goes to the driver's model
SAMPLE = 4000


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """Settled (doc_id, text, label) of the ``most`` training documents of either class whose ids have the least hashes.

    Only ids that ``documents`` has count; the choice depends on the rows alone, not on how they are dealt out. The list
    of ids, at most 2 * most, is broadcast. Null labels drop out; of several labels of an id the larger counts, of several
    texts the least.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    known = settle(known, "labelled")
    chosen = [tuple(r) for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    ids = spark.createDataFrame(chosen, "doc_id long, label int")
    return settle(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression on standardised features, for use on raw ones."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1] if x.ndim == 2 else 1), np.log(rate / (1 - rate)))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge * len(y)), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
