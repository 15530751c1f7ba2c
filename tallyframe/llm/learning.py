"""Bounded labelled samples, and small dense helpers for the models trained on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, text_col: str = "text", id_col: str = "doc_id", only_training: bool = False) -> DataFrame:
    """(doc_id, y, text) of at most ``limit`` labelled documents, chosen by a hash of the id.

    Rows without id, label or text are left out; of several labels of an id the
    larger counts, of several texts the smallest. The chosen ids, at most ``limit``
    longs, are what is broadcast.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    if only_training:
        chosen = chosen.where(~held_out(F.col(id_col)))
    chosen = chosen.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    chosen = chosen.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a whole bounded sample, in one task; only its result comes to the driver."""

    def run(batches):
        table = pa.Table.from_batches(batches)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(lambda b: run(b) if (b := list(b)) else iter(()), "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(sample.limit(0).toArrow())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of few columns by Newton steps: weights and intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([l2] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
