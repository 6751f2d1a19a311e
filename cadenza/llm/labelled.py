"""Bounded samples of labelled rows, and logistic regression on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, y (0 or 1): at most `per_class` labelled rows of each class, those whose ids hash lowest, with their
    whole texts.

    The ids are chosen first, so the join has a bounded side; texts stay on executors. Rows with null labels, ids or
    texts are left out. Of a repeated id the smallest text serves, and of its labels the smallest with that text.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # 2 * per_class ids at most
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.text", "r.y")


def positive_share(labels: DataFrame, label: str) -> float | None:
    """The share of label 1 among all labelled rows."""
    return labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights by Newton's method; the first column (ones) isn't shrunk."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * w)
        size = np.abs(step).max()
        w += step if size < 5 else step * (5 / size)
        if size < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
