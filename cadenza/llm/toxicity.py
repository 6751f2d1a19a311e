"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the rates of telling character 5-grams; each later
model also reads the probabilities of the earlier categories, and is trained on their out-of-fold predictions. The last
category is the label, and its probability, which reads all earlier ones, decides. Where labels only tell toxic or not,
the earlier categories are clusters of the toxic texts by their words. Rates don't grow with a text, so long clean texts
stay.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .labelled import labelled_rows, logistic, sigmoid

GRAM = 5
#: Characters in which one occurrence of a gram counts whole; in longer texts it counts as its share of a unit.
UNIT = 600
#: Clusters of toxic texts, and the hashed words by which they are found.
CLUSTERS, WORDS = 3, 512
#: Counters that a task holds before it passes them on.
HELD = 500_000


def grams(text: str) -> Counter:
    """Character 5-grams within words, with their number; a blank marks where a word begins or ends."""
    t = f" {' '.join(text.lower().split())} "
    return Counter(g for i in range(len(t) - GRAM + 1) if " " not in (g := t[i : i + GRAM])[1:-1])


def count_hits(text: str, automaton) -> Counter:
    """How often each telling gram occurs in the whole text."""
    return Counter(i for _, i in automaton.iter(f" {' '.join(text.lower().split())} ")) if automaton is not None else Counter()


@dataclass
class Chain:
    """A fitted chain: grams, and a weight vector (constant, grams, earlier categories) for each category."""

    categories: list[str]
    grams: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    _automaton: object = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None and self.grams:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, g in enumerate(self.grams):
                self._automaton.add_word(g, i)
            self._automaton.make_automaton()
        return self._automaton

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(constant and rate of each gram in a unit, 1 at most; number of hits) by text."""
        x, n = np.zeros((len(texts), 1 + len(self.grams))), np.zeros(len(texts))
        x[:, 0] = 1
        for k, t in enumerate(texts):
            hits = count_hits(t, self.automaton)
            share = UNIT / max(len(t), UNIT)
            x[k, [1 + i for i in hits]] = [min(1.0, c * share) for c in hits.values()]
            n[k] = sum(hits.values())
        return x, n

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each category in the order of the chain."""
        out = np.zeros((len(x), len(self.categories)))
        for k, w in enumerate(self.weights):
            m = x.shape[1]
            out[:, k] = sigmoid(x @ w[:m] + out[:, :k] @ w[m:])
        return out


@dataclass
class Occurrences:
    """How often each gram occurs in each text, as parallel arrays; only grams of `least` texts of label 1 are held."""

    names: list[str]
    text: np.ndarray
    gram: np.ndarray
    count: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str], y: np.ndarray, least: int) -> Occurrences:
        often: Counter = Counter()
        for t, k in zip(texts, y, strict=True):
            if k:
                often.update(grams(t).keys())
        names = sorted(g for g, c in often.items() if c >= least)
        number = {g: i for i, g in enumerate(names)}
        owner, gram, count = [], [], []
        for k, t in enumerate(texts):  # a text's grams at a time: all of them together are many times the texts
            own = {number[g]: c for g, c in grams(t).items() if g in number}
            owner.append(np.full(len(own), k, np.int32))
            gram.append(np.fromiter(own.keys(), np.int32, len(own)))
            count.append(np.fromiter(own.values(), np.int32, len(own)))
        return cls(names, np.concatenate(owner), np.concatenate(gram), np.concatenate(count), np.array([len(t) for t in texts]))

    def telling(self, y: np.ndarray, inside: np.ndarray, most: int, least: int) -> np.ndarray:
        """The grams most associated with label 1 among the texts `inside`, by the log-likelihood ratio."""
        own, n1 = inside[self.text], int(y[inside].sum())
        n0, size = int(inside.sum()) - n1, len(self.names)
        a = np.bincount(self.gram[own & (y[self.text] == 1)], minlength=size).astype(float)
        b = np.bincount(self.gram[own & (y[self.text] == 0)], minlength=size).astype(float)
        if not n0 or not n1:
            return np.zeros(0, np.int64)
        p = np.clip((a + b) / (n1 + n0), 1e-12, 1 - 1e-12)

        def part(k: np.ndarray, n: int) -> np.ndarray:
            some, rest = np.maximum(k, 1e-12), np.maximum(n - k, 1e-12)
            return k * np.log(some / n / p) + (n - k) * np.log(rest / n / (1 - p))

        ratio = np.where((a >= least) & (a * n0 > 3 * b * n1), np.round(part(a, n1) + part(b, n0), 9), 0.0)
        best = np.argsort(-ratio, kind="stable")[:most]
        return best[ratio[best] > 0]

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        """Chain.matrix for the chosen grams."""
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((len(self.length), 1 + len(chosen)))
        x[:, 0] = 1
        own = place[self.gram] >= 0
        share = UNIT / np.maximum(self.length, UNIT)
        x[self.text[own], 1 + place[self.gram[own]]] = np.minimum(1.0, self.count[own] * share[self.text[own]])
        return x


def word_counts(text: str) -> np.ndarray:
    """How often the words of each of WORDS hash values occur."""
    v = np.zeros(WORDS, np.int64)
    for w, c in Counter(text.lower().split()).items():
        v[zlib.crc32(w.encode()) % WORDS] += c
    return v


def clusters(counts: np.ndarray, k: int = CLUSTERS, rounds: int = 20) -> np.ndarray:
    """A cluster of each text by its word counts: spherical k-means, from starts far apart."""
    v = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    v -= v.mean(0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    centre = v[:1]
    while len(centre) < k:
        centre = np.concatenate([centre, v[[np.argmin((v @ centre.T).max(1))]]])
    for _ in range(rounds):
        own = np.argmax(v @ centre.T, 1)
        centre = np.stack([v[own == j].sum(0) if (own == j).any() else centre[j] for j in range(k)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return np.argmax(v @ centre.T, 1)


def targets_by_words(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Texts x categories where labels only tell toxic or not: toxic of each cluster, then toxic. counts: a row for each
    toxic text."""
    out = np.zeros((len(y), CLUSTERS + 1))
    out[np.flatnonzero(y == 1), clusters(counts)] = 1
    out[:, -1] = y
    return out


def targets_of(texts: list[str], y: np.ndarray) -> np.ndarray:
    return targets_by_words(np.stack([word_counts(texts[i]) for i in np.flatnonzero(y == 1)]), y)


def _new_chain(categories: list[str] | None) -> Chain:
    return Chain(categories or [*(f"kind_{i + 1}" for i in range(CLUSTERS)), "toxic"])


def _silent(chain: Chain) -> Chain:
    """A sample of one class fits a chain that never fires."""
    chain.weights = [np.concatenate([[-5.0], np.zeros(k)]) for k in range(len(chain.categories))]
    return chain


def _fit_links(chain: Chain, x: np.ndarray, t: np.ndarray, inner: list[tuple[np.ndarray, np.ndarray]], ridge: float) -> Chain:
    """x: texts x (constant, grams of the chain); t: texts x categories; inner: for each fold the texts outside it and the
    matrix of the grams that those chose."""
    earlier = np.zeros((len(x), 0))
    for k in range(t.shape[1]):
        chain.weights.append(logistic(np.concatenate([x, earlier], 1), t[:, k], ridge))
        outside = sigmoid(np.concatenate([x, earlier], 1) @ chain.weights[-1])  # all ids in one fold: no other texts to fit on
        for inside, own in inner:
            own = np.concatenate([own, earlier], 1)
            outside[~inside] = sigmoid(own[~inside] @ logistic(own[inside], t[inside, k], ridge))
        earlier = np.concatenate([earlier, outside[:, None]], 1)
    return chain


def fit_chain(sample: list[tuple[int, str, int]], categories: list[str] | None = None, targets: np.ndarray | None = None, *, most: int = 512, least: int = 5, folds: int = 5, ridge: float = 1.0) -> Chain:
    """The fit of a sample in memory; `fit` gives the same chain from tables.

    targets: texts x categories of 0 and 1, in the order of the chain; the last is the label itself. Without targets,
    `targets_of` derives them. Folds go by id; each chooses its grams and fits its models without its own texts, and
    gives the out-of-fold probabilities that later models are trained on."""
    chain = _new_chain(categories)
    texts, y = [t for _, t, _ in sample], np.array([k for _, _, k in sample], float)
    if not len(y) or y.min() == y.max():
        return _silent(chain)
    seen, t = Occurrences.of(texts, y, least), targets_of(texts, y) if targets is None else targets
    every = np.ones(len(y), bool)
    chosen = seen.telling(y, every, most, least)
    chain.grams = [seen.names[i] for i in chosen]
    fold = np.array([i % folds for i, _, _ in sample])
    inner = [(fold != f, seen.matrix(seen.telling(y, fold != f, most, least))) for f in range(folds) if (fold == f).any() and (fold != f).any()]
    return _fit_links(chain, seen.matrix(chosen), t, inner, ridge)


def _gram_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, gram, number of texts) from (part, text), added up within a task."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.int32()), pa.array([g for _, g in keys], pa.string()), pa.array(list(held.values()), pa.int64())], ["part", "gram", "n"])

    for b in batches:
        for part, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held.update((part, g) for g in grams(text.as_py()))
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def _evidence(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    """What a labelled text tells the fit: length, hits of the chain's grams, and the word counts of a toxic one."""
    for b in batches:
        for doc, text, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            t = text.as_py()
            hits = sorted(count_hits(t, chain.automaton).items())
            values = [doc, y, len(t), [i for i, _ in hits], [c for _, c in hits], word_counts(t).tolist() if y else None]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["doc_id", "y", "length", "grams", "counts", "words"])


def _ratio(a: Column, n1: int, b: Column, n0: int) -> Column:
    """Occurrences.telling's log-likelihood ratio of a gram in a of n1 toxic and b of n0 other texts."""
    lowest, p = F.lit(1e-12), F.greatest(F.least((a + b) / (n1 + n0), F.lit(1 - 1e-12)), F.lit(1e-12))

    def part(k: Column, n: int) -> Column:
        return k * F.log(F.greatest(k, lowest) / n / p) + (F.lit(n) - k) * F.log(F.greatest(F.lit(n) - k, lowest) / n / (1 - p))

    return F.round(part(a, n1) + part(b, n0), 9)


def _telling(rows: DataFrame, size: dict[int, int], folds: int, most: int, least: int, scratch: Scratch) -> dict[int, list[str]]:
    """The telling grams of all texts (key -1) and of those outside each fold. Texts with a gram are counted by fold and
    class on executors; at most (folds + 1) * most grams come to the driver."""
    parts = rows.select((F.pmod("doc_id", F.lit(folds)) * 2 + F.col("y")).cast("int").alias("part"), "text")
    seen = parts.mapInArrow(_gram_texts, "part int, gram string, n long").groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("part") == k, F.col("n"))), F.lit(0)).cast("double").alias(f"n_{k}") for k in range(2 * folds)))
    toxic = sum((F.col(f"n_{2 * f + 1}") for f in range(1, folds)), F.col("n_1"))
    table = scratch.table(seen.where(toxic >= least), "grams")
    found = None
    for out in range(-1, folds):
        inside = [f for f in range(folds) if f != out]
        n0, n1 = (sum(size.get(2 * f + y, 0) for f in inside) for y in (0, 1))
        if not n0 or not n1:
            continue
        b, a = (functools.reduce(lambda s, c: s + c, [F.col(f"n_{2 * f + y}") for f in inside]) for y in (0, 1))
        best = table.where((a >= least) & (a * n0 > 3 * b * n1)).select(F.lit(out).alias("out"), "gram", _ratio(a, n1, b, n0).alias("ratio")).where("ratio > 0")
        best = best.orderBy(F.col("ratio").desc(), "gram").limit(most)
        found = best if found is None else found.unionByName(best)
    grams_of: dict[int, list[str]] = {out: [] for out in range(-1, folds)}
    for r in sorted(found.collect(), key=lambda r: (-r["ratio"], r["gram"])) if found is not None else ():
        grams_of[r["out"]].append(r["gram"])
    scratch.drop(table)
    return grams_of


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            p = chain.predict(chain.matrix(part)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), *(pa.array(c) for c in p.T)], ["doc_id", *(f"p_{c}" for c in chain.categories)])


def _clean(batches: Iterator[pa.RecordBatch], at: int, chain: Chain, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            p = chain.predict(chain.matrix([t or "" for t in part.column(at).to_pylist()])[0])
            yield part.filter(pa.array(p[:, -1] < threshold))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text", most: int = 512, least: int = 5, folds: int = 5, ridge: float = 1.0) -> Chain:
    """Fits a chain on at most 2 * per_class labelled documents, whose whole texts are read by executors.

    The driver gets the telling grams, at most (folds + 1) * most, and for each labelled document its length, its counts
    of those grams and, of a toxic one, its WORDS word counts; the models are fitted on these. No labelled row with a
    text, or rows of one class alone, give a chain that never fires."""
    scratch, chain = Scratch(docs.sparkSession, "toxicity"), _new_chain(None)
    rows = scratch.table(labelled_rows(docs, labels, label, per_class=per_class, id_col=id_col, text_col=text_col), "sample")
    size = {r["part"]: r["count"] for r in rows.groupBy((F.pmod("doc_id", F.lit(folds)) * 2 + F.col("y")).cast("int").alias("part")).count().collect()}
    if len({k % 2 for k in size}) < 2:
        return _silent(chain)
    telling = _telling(rows, size, folds, most, least, scratch)
    names = sorted(set().union(*telling.values()))
    found = rows.mapInArrow(functools.partial(_evidence, chain=Chain([], names)), "doc_id long, y int, length long, grams array<int>, counts array<long>, words array<long>").collect()
    found.sort(key=lambda r: r["doc_id"])
    scratch.drop(rows)
    hits = [len(r["grams"]) for r in found]
    gram, count = (np.fromiter((v for r in found for v in r[c]), np.int64, sum(hits)) for c in ("grams", "counts"))
    seen = Occurrences(names, np.repeat(np.arange(len(found)), hits), gram, count, np.array([r["length"] for r in found]))
    y, fold = np.array([r["y"] for r in found], float), np.array([r["doc_id"] % folds for r in found])
    number = {g: i for i, g in enumerate(names)}
    matrix = {out: seen.matrix(np.array([number[g] for g in own], np.int64)) for out, own in telling.items()}
    inner = [(fold != f, matrix[f]) for f in range(folds) if (fold == f).any() and (fold != f).any()]
    chain.grams = telling[-1]
    return _fit_links(chain, matrix[-1], targets_by_words(np.array([r["words"] for r in found if r["y"]]), y), inner, ridge)


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, p_<category> for each category of the chain, toxic (0 or 1: the last category's
    probability reaches the threshold). Whole texts are read.

    Null or empty text: no gram, so the constants decide (not toxic). Null ids and repeated rows each get a row. Other
    columns are ignored. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    p = [f"p_{c}" for c in chain.categories]
    scored = src.mapInArrow(functools.partial(_score, chain=chain), "doc_id long, " + ", ".join(f"{c} double" for c in p))
    return scored.select("doc_id", *p, (F.col(p[-1]) >= threshold).cast("int").alias("toxic"))


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the chain doesn't call toxic, all columns; null texts stay."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(functools.partial(_clean, at=at, chain=chain, threshold=threshold), docs.schema)
