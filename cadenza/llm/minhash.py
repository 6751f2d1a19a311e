"""MinHash near-duplicates with sequential Bayesian verification.

Signatures of 128 minima are cut into 32 bands of 4; documents that agree on a band are candidates. Candidates are
compared in batches of 32 minima: after n comparisons with m agreements the posterior of the similarity under a flat
prior is Beta(m + 1, n - m + 1), and a pair goes as soon as P(similarity >= threshold) falls below `miss`. The full
shingle sets of what survives decide. Equal sets are one class from the start, and a block of candidates yields a
spanning forest of its links, never its pairs. Words are told apart by their bytes and named by a keyed 128-bit hash;
a shingle is named by 64 bits that are mixed, word by word, from the names of its words, and a set by 128.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_batches, binary_array, connected_components, distinct_spans, join_spread, mix, prefix_hash, span_hash, text_pieces

MINIMA, BANDS, BATCH = 128, 32, 32
ROWS = MINIMA // BANDS
#: Documents of a candidate block; larger buckets are cut into pairs of such blocks.
BLOCK = 4096
#: Seed of the names of words.
KEY = 0x51ED270B7F3A9C25
_U = np.uint64
_rng = np.random.default_rng(7919)
_XOR = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_POS = _rng.integers(0, 2**63, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the name of each word, a row each."""
    first, which = distinct_spans(data, start, end, span_hash(prefix_hash(data), start, end))
    raw, named = data.tobytes(), xxhash.xxh3_128_digest
    spans = zip(start[first].tolist(), end[first].tolist(), strict=True)
    names = np.frombuffer(b"".join([named(raw[s:e], KEY) for s, e in spans]), _U).reshape(-1, 2)
    return names[which].T


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the distinct shingles, sorted by document; their number by document; another 64 bits of each shingle)."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    sep = _SEP[data]
    before = np.concatenate([[True], sep[:-1]])
    start, end = np.flatnonzero(~sep & before), np.flatnonzero(sep & ~before)
    if not len(start):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64), np.zeros(0, _U)
    doc = np.searchsorted(first, start, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(n)
    k = np.arange(len(start))
    room = ends[doc] - k
    halves = []
    for name in word_names(data, start, end):
        h = np.zeros(len(name), _U)
        for j in range(words):  # short documents: what there is, from the first word alone
            at = np.minimum(k + j, len(name) - 1)
            h = np.where(room > j, mix(h * _POS[j % 64] + name[at], j + 1), h)
        halves.append(h)
    keep = (room >= words) | ((n[doc] < words) & (k == (ends - n)[doc]))
    h, other, doc = halves[0][keep], halves[1][keep], doc[keep]
    stops = np.cumsum(np.bincount(doc, minlength=len(texts)))
    for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
        if b - a > 1:
            by = np.argsort(h[a:b])
            h[a:b], other[a:b] = h[a:b][by], other[a:b][by]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[new], np.bincount(doc[new], minlength=len(texts)), other[new]


def signatures(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """len(counts) x MINIMA minima of uint32; rows without shingles are all ones."""
    out = np.full((len(counts), MINIMA), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        x = (keys >> _U(32)).astype(np.uint32)
        y = np.empty_like(x)
        for i in range(MINIMA):
            np.bitwise_xor(x, _XOR[i], out=y)
            np.multiply(y, _MUL[i], out=y)
            out[full, i] = np.minimum.reduceat(y, starts)
    return out


def min_matches(threshold: float, miss: float) -> dict[int, int]:
    """The fewest agreements among n with which a pair goes on: P(similarity >= threshold) = P(Bin(n + 1, threshold) <= m)."""
    out = {}
    for n in range(BATCH, MINIMA + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out[n] = m
    return out


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_pieces(batches):
        keys, counts, other = shingle_sets(texts, words)
        sig = signatures(keys, counts)
        full, sums = counts > 0, np.zeros((2, len(ids)), np.int64)
        if full.any():
            starts = (np.cumsum(counts) - counts)[full]
            for j, h in enumerate((mix(keys, 0xABCDEF), mix(other, 0xABCDF0))):
                sums[j, full] = np.add.reduceat(h, starts).view(np.int64)
        yield from as_batches(pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64()), "c1": sums[0], "c2": sums[1],
            "sig": binary_array(sig, np.arange(1, len(ids) + 1) * (4 * MINIMA)),
        }), 2000)


def _sigs(b: pa.RecordBatch, column: str = "sig") -> np.ndarray:
    col = b.column(column).cast(pa.large_binary())
    if not len(col):
        return np.zeros((0, MINIMA), np.uint32)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, MINIMA)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, ids = _sigs(b), b.column("doc_id").to_numpy()
        keys = np.empty((len(ids), BANDS), np.int64)
        for j in range(BANDS):
            h = sig[:, j * ROWS : (j + 1) * ROWS].astype(_U)
            keys[:, j] = mix((h * _POS[:ROWS]).sum(1, dtype=_U), j + 1).view(np.int64)
        yield from as_batches(pa.table({"key": keys.ravel(), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(ids)), "doc_id": np.repeat(ids, BANDS)}), 100_000)


def _blocks(ids: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Blocks that hold every pair of ids: (members, how many of them form the left side; 0: all pairs)."""
    cuts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    for i, a in enumerate(cuts):
        yield a, 0
        for b in cuts[i + 1 :]:
            yield np.concatenate([a, b]), len(a)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> the blocks of every key that two documents share."""
    rows: list[tuple[int, np.ndarray, int]] = []

    def emit(band: int, ids: np.ndarray) -> None:
        ids = np.unique(ids)
        if len(ids) > 1:
            rows.extend((band, members, left) for members, left in _blocks(ids))

    def out() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32())], ["band", "members", "left"])
        rows.clear()

    carry: tuple[int, int, list[np.ndarray]] | None = None
    for b in batches:
        key, band, ids = (b.column(c).to_numpy() for c in ("key", "band", "doc_id"))
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.append(cuts, len(key)))
        for c, s in zip(cuts, sizes, strict=True):
            if carry and carry[0] == key[c]:
                carry[2].append(ids[c : c + s])
                continue
            if carry and sum(map(len, carry[2])) > 1:
                emit(carry[1], np.concatenate(carry[2]))
            carry = (int(key[c]), int(band[c]), [ids[c : c + s]])
        if sum(len(r[1]) for r in rows) > 50_000:
            yield from out()
    if carry and sum(map(len, carry[2])) > 1:
        emit(carry[1], np.concatenate(carry[2]))
    if rows:
        yield from out()


def distinct_blocks(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of equal members once, with the first band that has them and a number of their own."""
    once = found.groupBy("members", "left").agg(F.min("band").alias("band"))
    return scratch.table(once.select(F.monotonically_increasing_id().alias("gid"), "band", "members", "left"), "blocks")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of equal gid, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        gid = b.column("gid").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        for c, e in zip(cuts, [*cuts[1:], len(gid)], strict=True):
            if held and last != gid[c]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(c, e - c))
            last = gid[c]
    if held:
        yield pa.Table.from_batches(held)


def survivors(sig: np.ndarray, left: np.ndarray, cross: bool, band: int, least: dict[int, int]) -> np.ndarray:
    """Which rows of a block have a pair that the posterior bounds keep and that no earlier band holds."""
    alive = np.zeros(len(sig), bool)
    step = max(1, 1_000_000 // max(1, len(sig)))
    for i in range(0, len(sig), step):
        rows = np.arange(i, min(i + step, len(sig)))
        ok = rows[:, None] < np.arange(len(sig))[None, :]
        if cross:
            ok &= left[rows][:, None] != left[None, :]
        x, y = np.nonzero(ok)
        x += i
        agree = np.zeros(len(x), np.int16)
        for n in range(BATCH, MINIMA + 1, BATCH):
            for j in range(n - BATCH, n):
                agree += sig[x, j] == sig[y, j]
            keep = agree >= least[n]
            x, y, agree = x[keep], y[keep], agree[keep]
        if len(x):
            first = np.full(len(x), BANDS)
            for j in range(band, -1, -1):
                first[(sig[x, j * ROWS : (j + 1) * ROWS] == sig[y, j * ROWS : (j + 1) * ROWS]).all(1)] = j
            x, y = x[first == band], y[first == band]
            alive[x] = alive[y] = True
    return alive


def _prune(batches: Iterator[pa.RecordBatch], threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    least = min_matches(threshold, miss)
    held: list[pa.Table] = []
    for t in _groups(batches):
        left = t.column("is_left").to_numpy()
        sig = _sigs(t)
        keep = survivors(sig, left, bool(t.column("cross")[0].as_py()), t.column("band")[0].as_py(), least)
        if keep.any():
            held.append(t.select(["gid", "doc_id", "is_left", "cross"]).filter(pa.array(keep)))
        if sum(map(len, held)) > 20_000:
            yield from as_batches(pa.concat_tables(held))
            held = []
    if held:
        yield from as_batches(pa.concat_tables(held))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, groups) -> a row with the whole shingle set for each group of the document."""
    for b in batches:
        groups = b.column("groups").to_pylist()
        at = 0
        for ids, texts in text_pieces(iter([b.select([0, 1])])):
            keys, counts, _ = shingle_sets(texts, words)
            sets = np.split(keys, np.cumsum(counts)[:-1])
            rows = [(g["gid"], i, g["is_left"], g["cross"], s.tobytes()) for i, s, gs in zip(ids, sets, groups[at : at + len(ids)], strict=True) for g in gs]
            at += len(ids)
            yield from as_batches(pa.table({
                "gid": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "is_left": pa.array([r[2] for r in rows], pa.bool_()),
                "cross": pa.array([r[3] for r in rows], pa.bool_()), "shingles": pa.array([r[4] for r in rows], pa.binary()),
            }), 500)


def forest(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that join what pairs with den * intersection >= num * union join; each set is counted against all others at once."""
    everything = np.concatenate(sets) if sets else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    label, edges = np.arange(len(sets)), []
    for i in range(len(sets)):
        lo, hi = np.searchsorted(everything, sets[i], "left"), np.searchsorted(everything, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        linked = (den * common >= num * (sizes[i] + sizes - common)) & (label != label[i])
        if cross:
            linked &= left != left[i]
        for j in np.flatnonzero(linked):
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]
    return edges


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for t in _groups(batches):
        sets = [np.frombuffer(x, _U) for x in t.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        ids = t.column("doc_id").to_pylist()
        for i, j in forest(sets, sizes, t.column("is_left").to_numpy(), bool(t.column("cross")[0].as_py()), num, den):
            a.append(ids[i])
            b.append(ids[j])
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and \\t-\\r, with A-Z lower-cased; a document's set holds its distinct
    shingles of `words` words, its whole word sequence when that is shorter, nothing without words. Documents with
    den * |intersection| >= num * |union| are linked; component_id is the smallest doc_id that links reach.

    Null or empty text: no shingles, linked with nothing, kept. Null doc_id: linked with nothing, component_id null,
    kept. Repeated rows each get a row; an id with several texts joins what they are linked with. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    # Tables with a row per document are joined by shuffles at every size: none of them has a bound that allows a broadcast.
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.table(src.mapInArrow(functools.partial(_sign, words=words), "doc_id long, n long, c1 long, c2 long, sig binary"), "signed")
    n = signed.count()
    classes = scratch.table(signed.where("n > 0 and doc_id is not null").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    reps = scratch.table(signed.where("n > 0").join(classes.select("c1", "c2", "n", "doc_id").hint("merge"), ["c1", "c2", "n", "doc_id"], "left_semi").select("doc_id", "sig"), "reps")
    keyed = reps.mapInArrow(_bands, "key long, band int, doc_id long").repartition("key").sortWithinPartitions("key")
    blocks = distinct_blocks(keyed.mapInArrow(_buckets, "band int, members array<long>, left int"), scratch)
    members = blocks.select("gid", "band", "left", F.posexplode("members").alias("at", "doc_id")).select("gid", "band", "doc_id", (F.col("at") < F.col("left")).alias("is_left"), (F.col("left") > 0).alias("cross"))
    pruned = members.join(reps.hint("merge"), "doc_id").repartition("gid").sortWithinPartitions("gid").mapInArrow(functools.partial(_prune, threshold=num / den, miss=miss), "gid long, doc_id long, is_left boolean, cross boolean")
    pruned = scratch.table(pruned, "pruned")
    wanted = pruned.groupBy("doc_id").agg(F.collect_list(F.struct("gid", "is_left", "cross")).alias("groups"))
    sets = src.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "groups").mapInArrow(functools.partial(_sets, words=words), "gid long, doc_id long, is_left boolean, cross boolean, shingles binary")
    links = sets.repartition("gid").sortWithinPartitions("gid").mapInArrow(functools.partial(_verify, num=num, den=den), "a long, b long")
    found = connected_components(links, scratch)
    scratch.drop(reps, blocks, pruned)
    named = classes.join(found, classes.doc_id == found.id, "left").select("c1", "c2", "n", "copies", F.coalesce("component", "doc_id").alias("component"))
    slim = signed.select("doc_id", "n", "c1", "c2")
    out = join_spread(slim.where("n > 0 and doc_id is not null"), named, ["c1", "c2", "n"], "copies", n).select("doc_id", "n", "component")
    out = out.unionByName(slim.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component")))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
