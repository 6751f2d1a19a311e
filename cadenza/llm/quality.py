"""Quality by compression: zstandard dictionaries of good and of bad texts.

A text is compressed with either dictionary. The normalised difference of the two sizes, and the smaller one by byte,
are calibrated to a probability by logistic regression on labelled texts outside the dictionaries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .labelled import labelled_rows, logistic, positive_share, sigmoid

DICTIONARY, LEVEL, SLICE = 65_536, 3, 200


def dictionaries(bad: list[bytes], good: list[bytes]) -> tuple[bytes, bytes]:
    """Trained dictionaries of slices of either class's texts, of one size: at most DICTIONARY and a tenth of the smaller
    class's bytes. Where that is too little to train both, neither class has one."""
    size = min(DICTIONARY, min(sum(map(len, bad)), sum(map(len, good))) // 10)
    slices = [[t[i : i + SLICE] for t in texts for i in range(0, len(t), SLICE)] for texts in (bad, good)]
    try:
        return tuple(zstandard.train_dictionary(size, s).as_bytes() for s in slices)
    except (zstandard.ZstdError, ValueError):
        return b"", b""


@dataclass
class Model:
    bad: bytes
    good: bytes
    weights: np.ndarray
    level: int = LEVEL

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) if d else zstandard.ZstdCompressor(level=self.level, write_content_size=False) for d in (self.bad, self.good)]


def features(texts: list[bytes], model: Model) -> np.ndarray:
    """Constant, difference of sizes (bad - good, by the larger), smaller size by byte, and their squares and product."""
    bad, good = model.compressors()
    sizes = np.array([[len(bad.compress(t)), len(good.compress(t)), max(len(t), 1)] for t in texts], float).reshape(-1, 3)
    x = (sizes[:, 0] - sizes[:, 1]) / sizes[:, :2].max(1, initial=1)
    r = np.minimum(sizes[:, :2].min(1, initial=np.inf) / sizes[:, 2], 3)
    return np.stack([np.ones(len(x)), x, r, x * x, r * r, x * r], 1)


def in_dictionary(sizes: list[tuple[int, int, int]], dictionary_bytes: int) -> tuple[list[int], list[int]]:
    """(ids whose texts make the dictionaries, ids that calibrate), in an order by hashed id, from (doc_id, y, bytes): the
    first texts of each class, until they have `dictionary_bytes` or half of the class's bytes."""
    totals = {y: sum(n for _, k, n in sizes if k == y) for y in (0, 1)}
    used, first, rest = {0: 0, 1: 0}, [], []
    for i, y, n in sorted(sizes, key=lambda r: ((r[0] * 2654435761) % 2**32, r[0])):
        if used[y] < min(dictionary_bytes, totals[y] / 2):
            first.append(i)
            used[y] += n
        else:
            rest.append(i)
    return first, rest


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, share: float | None) -> Model:
    """Weights from the features x of texts outside the dictionaries, weighted so that label 1 has the given share."""
    if len(y) and y.min() < y.max():
        share = y.mean() if share is None else min(max(share, 1e-6), 1 - 1e-6)
        model.weights = logistic(x, y, 1e-3, weight=np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    elif len(y):
        model.weights[0] = 3.0 if y[0] else -3.0
    return model


def fit_sample(sample: list[tuple[int, str, int]], share: float | None = None, *, dictionary_bytes: int = 2_000_000) -> Model:
    """The fit of a sample in memory (ids differ); `fit` gives the same model from tables."""
    own = {i: (t.encode(), y) for i, t, y in sample}
    first, rest = in_dictionary([(i, y, len(b)) for i, (b, y) in own.items()], dictionary_bytes)
    model = Model(*dictionaries(*([own[i][0] for i in first if own[i][1] == y] for y in (0, 1))), np.zeros(6))
    return calibrate(model, features([own[i][0] for i in rest], model), np.array([own[i][1] for i in rest], float), share)


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features([t.as_py() for t in b.column(1).cast(pa.binary())], model)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text", dictionary_bytes: int = 2_000_000) -> Model:
    """Fits on at most 2 * per_class labelled rows with their whole texts.

    The driver gets the sizes of these, the texts of the dictionaries (of each class `dictionary_bytes` and the rest of
    one text at most), and six features of each other text, which executors compress."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    rows = scratch.table(labelled_rows(docs, labels, label, per_class=per_class, id_col=id_col, text_col=text_col), "sample")
    sizes = [(r["doc_id"], r["y"], r["n"]) for r in rows.select("doc_id", "y", F.octet_length("text").alias("n")).collect()]
    first, rest = in_dictionary(sizes, dictionary_bytes)
    ids = F.broadcast(spark.createDataFrame([(i,) for i in first], "doc_id long"))
    own = {r["doc_id"]: (r["text"].encode(), r["y"]) for r in rows.join(ids, "doc_id").collect()}
    model = Model(*dictionaries(*([own[i][0] for i in first if own[i][1] == y] for y in (0, 1))), np.zeros(6))
    found = {r["doc_id"]: r for r in rows.join(ids, "doc_id", "left_anti").select("doc_id", "text", "y").mapInArrow(functools.partial(_features, model=model), "doc_id long, y int, x array<double>").collect()}
    scratch.drop(rows)
    x = np.array([found[i]["x"] for i in rest]).reshape(-1, 6)
    return calibrate(model, x, np.array([found[i]["y"] for i in rest], float), positive_share(labels, label))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        score = sigmoid(features(texts, model) @ model.weights) if texts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher is better), predicted (1 if score >= threshold). Only texts
    are read, whole.

    Null text counts as empty; empty texts are scored too. Null ids and repeated rows each get a row. Other columns are
    ignored. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(functools.partial(_score, model=model), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
