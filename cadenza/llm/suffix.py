"""Removal of repeated passages with suffix arrays built by two-stage sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier (in a document of smaller id, or further
left in the same one). Strings are dealt to tasks by content: each string of `length` bytes has an anchor, the leftmost
of its k-grams with the smallest hash, so equal strings have equal anchors. A run of strings with one anchor is a
segment. Segments meet by the anchor's fingerprint; equal segments (by 96 bits of a keyed hash of their bytes) are combined
before the shuffle, and only those that share an anchor with a different segment have their bytes fetched, put into a
suffix array and compared with their neighbours in it. Anchors with very many different segments are dealt again by
nearly whole strings.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, prefix_hash, span_hash, text_pieces

GRAM = 24
#: Segments of one anchor beyond which they are dealt by cores of nearly `length` bytes, STEP starts to a core.
HOT, STEP = 256, 8
#: Bytes that go into a suffix array, about: segments that may share a string stay together.
ARRAY_BYTES = 1_000_000
#: Bytes of text that the first pass looks at together: some 80 bytes of arrays for each.
OWN_PIECE = 500_000
#: Segments that a task of the first pass holds before it deals them out.
HELD = 100_000
_U = np.uint64
#: Seed of the hashes of segments.
KEY = 0x2545F4914F6CDD1D
#: Bytes of text to a partition at most, about; more partitions than spark.sql.shuffle.partitions if that takes it.
PART_BYTES = 64_000_000
SEGMENT = np.dtype([("fp", "u8"), ("ch", "u8"), ("ch2", "u4"), ("doc", "i8"), ("lo", "u4"), ("anchor", "u1"), ("n", "u1")])
MARK = np.dtype([("doc", "i8"), ("start", "u4"), ("end", "u4")])
REQUEST = np.dtype([("fp", "u8"), ("doc", "i8"), ("lo", "u4"), ("anchor", "u1"), ("n", "u1"), ("hot", "u1")])
PIECE = np.dtype([("doc", "i8"), ("lo", "u4"), ("size", "u2"), ("n", "u2"), ("part", "u2")])
ROW = "target int, kind int, doc_id long, head binary, body binary"
MARKS, SEGMENTS, REQUESTS, TEXT = 1, 2, 3, 9


# --------------------------------------------------------------------------- suffix arrays


def packed(text: np.ndarray, symbols: int = 7) -> np.ndarray:
    """By position: its next 7 symbols of 9 bits in one integer."""
    padded = np.concatenate([text.astype(_U), np.zeros(symbols, _U)])
    out = np.zeros(len(text), _U)
    for j in range(symbols):
        out = (out << _U(9)) | padded[j : j + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts one further right; 0 ends a string, and its suffixes count as smaller."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int32)))
    at = np.flatnonzero(step)
    nearest = np.searchsorted(at, np.arange(len(text)))
    down = np.append(step[at], 1)[nearest] < 0
    return ~down | (text == 0)


def direct_sort(at: np.ndarray, key: np.ndarray, depth: int, whole: np.ndarray) -> np.ndarray:
    """Positions sorted by their next `depth` symbols. `whole` (a hash of them) only tells when a group is equal throughout."""
    order = at[np.argsort(key[at], kind="stable")]
    value = key[order]
    group = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if len(order) else np.zeros(0, np.int64)
    last = len(key) - 1
    active = np.arange(len(order))
    for d in range(7, depth, 7):
        g = group[active]
        h = whole[order[active]]
        begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        if not len(begins):
            break
        mixed = np.minimum.reduceat(h, begins) != np.maximum.reduceat(h, begins)
        active = active[np.repeat(mixed, np.diff(np.append(begins, len(g))))]
        if not len(active):
            break
        g, own = group[active], order[active]
        k = key[np.minimum(own + d, last)]
        again = np.lexsort((k, g))
        order[active] = own[again]
        k, g = k[again], g[again]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
    return order


def suffix_array(text: np.ndarray, key: np.ndarray, depth: int, whole: np.ndarray) -> np.ndarray:
    """Two-stage sorting by the first `depth` symbols: the suffixes smaller than their successor are sorted directly;
    a scan of the buckets from the smallest first symbol on places every other one right after its successor was."""
    small = smaller_than_next(text)
    ends = text == 0
    direct = direct_sort(np.flatnonzero(small & ~ends), key, depth, whole)
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(258)]
    out: list[np.ndarray] = []
    for c in range(257):
        if c == 0:
            bucket = np.flatnonzero(ends)
        else:
            parts = [np.concatenate(pending[c])] if pending[c] else []
            current = parts[0] if parts else np.zeros(0, np.int64)
            while len(current):  # runs of one symbol
                before = current[current > 0] - 1
                current = before[text[before] == c]
                parts.append(current)
            bucket = np.concatenate([*parts, direct[cuts[c] : cuts[c + 1]]])
        pending[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            symbol = text[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            begins = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            for s, part in zip(symbol[begins].tolist(), np.split(before, begins[1:]), strict=True):
                pending[s].append(part)
    return np.concatenate(out)


def common_prefixes(sa: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares `depth` symbols with the one before it in the array."""
    same = np.zeros(len(sa), bool)
    alive = np.arange(1, len(sa))
    last = len(key) - 1
    for d in [*range(0, depth - 6, 7), max(0, depth - 7)]:
        alive = alive[key[np.minimum(sa[alive] + d, last)] == key[np.minimum(sa[alive - 1] + d, last)]]
    same[alive] = True
    return same


def repeats(head: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """MARKs of the strings in segments (PIECE heads, their bytes one after another) that start earlier in another."""
    size = head["size"].astype(np.int64)
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    text = np.zeros(int(ends[-1]), np.uint16)
    mask = np.ones(len(text), bool)
    mask[ends - 1] = False
    text[mask] = body.astype(np.uint16) + np.uint16(1)
    key = packed(text)
    prefix = prefix_hash((text & 0xFF).astype(np.uint8))
    at = np.arange(len(text))
    whole = span_hash(prefix, at, np.minimum(at + length, len(text)))
    sa = suffix_array(text, key, length, whole)
    owner = np.repeat(np.arange(len(head)), size + 1)
    inside = at - starts[owner]
    sa = sa[inside[sa] < head["n"][owner[sa]]]  # strings of whole length that belong to the segment
    if not len(sa):
        return np.zeros(0, MARK)
    group = np.cumsum(~common_prefixes(sa, key, length))
    doc, start = head["doc"][owner[sa]], head["lo"][owner[sa]].astype(np.int64) + inside[sa]
    by = np.lexsort((start, doc, group))
    g, d, s = group[by], doc[by], start[by]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    reach = np.diff(np.append(begins, len(g)))
    later = (d != np.repeat(d[begins], reach)) | (s != np.repeat(s[begins], reach))
    return marks(d[later], s[later], s[later] + length)


# --------------------------------------------------------------------------- intervals


def marks(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Intervals, joined where they touch."""
    if not len(doc):
        return np.zeros(0, MARK)
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by].astype(np.int64), end[by].astype(np.int64)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    run = np.cumsum(new)
    reach = np.maximum.accumulate(end + run * (1 << 33)) - run * (1 << 33)
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = np.zeros(len(first), MARK)
    out["doc"], out["start"], out["end"] = doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]
    return out


# --------------------------------------------------------------------------- rows that carry arrays


def _deal(values: np.ndarray, by: np.ndarray, targets: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows of ROW: the values of each target in one binary."""
    if not len(values):
        return
    part = (mix(by.astype(_U), 77) % _U(len(targets))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    values = values[order]
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for b, e in zip(begins, [*begins[1:], len(part)], strict=True):
        yield int(targets[part[b]]), kind, None, values[b:e].tobytes(), None


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    for i in range(0, len(rows), 200):
        cols = list(zip(*rows[i : i + 200], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["target", "kind", "doc_id", "head", "body"])


def segments(ids: np.ndarray, texts: list[bytes], length: int) -> Iterator[np.ndarray]:
    """The SEGMENTs of documents; long ones go by parts, each string of `length` bytes in the part where it starts."""
    if len(texts) > 1 or len(texts[0]) <= OWN_PIECE:
        yield _segments(ids, texts, length)
        return
    for base in range(0, len(texts[0]) - length + 1, OWN_PIECE):
        out = _segments(ids, [texts[0][base : base + OWN_PIECE + length - 1]], length)
        out["lo"] += np.uint32(base)
        yield out


def _segments(ids: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    if len(data) < length:
        return np.zeros(0, SEGMENT)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    low = _U((1 << 28) - 1)
    least = (gram & ~low) | at.astype(_U)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    first = np.cumsum(sizes) - sizes
    whole = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), whole)
    start = np.repeat(first - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
    if not len(start):
        return np.zeros(0, SEGMENT)
    anchor = (least[start] & low).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    b = np.flatnonzero(new)
    e = np.append(b[1:], len(start)) - 1
    out = np.zeros(len(b), SEGMENT)
    lo, hi, p = start[b], start[e], anchor[b]
    named = xxhash.xxh3_128_digest
    names = np.frombuffer(b"".join([named(raw[i:j], KEY) for i, j in zip(lo.tolist(), (hi + length).tolist(), strict=True)]), _U).reshape(-1, 2)
    out["fp"], out["ch"], out["ch2"] = mix(gram[p], 5), names[:, 0], (names[:, 1] >> _U(32)).astype(np.uint32)
    out["doc"], out["lo"], out["anchor"], out["n"] = ids[doc[b]], lo - first[doc[b]], p - lo, hi - lo + 1
    return out


def combine(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal segments, and the marks of the others. s comes back sorted by fp, ch."""
    s = s[np.lexsort((s["lo"], s["doc"], s["ch2"], s["ch"], s["fp"]))]
    new = np.concatenate([[True], (s["fp"][1:] != s["fp"][:-1]) | (s["ch"][1:] != s["ch"][:-1]) | (s["ch2"][1:] != s["ch2"][:-1])])
    b = np.flatnonzero(new)
    reach = np.diff(np.append(b, len(s)))
    later = (s["doc"] != np.repeat(s["doc"][b], reach)) | (s["lo"] != np.repeat(s["lo"][b], reach))
    t = s[later]
    return s[b], marks(t["doc"], t["lo"], t["lo"].astype(np.int64) + t["n"] - 1 + length)


def _first(batches: Iterator[pa.RecordBatch], length: int, targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        kept, gone = combine(np.concatenate(held), length)
        held.clear()
        yield from _rows([*_deal(kept, kept["fp"], targets, SEGMENTS), *_deal(gone, gone["doc"], targets, MARKS)])

    for ids, texts in text_pieces(batches, OWN_PIECE):
        for part in segments(np.array(ids, np.int64), texts, length):
            held.append(part)
            if sum(map(len, held)) > HELD:
                yield from out()
    if sum(map(len, held)):
        yield from out()


def _second(batches: Iterator[pa.RecordBatch], length: int, targets: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """All segments of some fingerprints -> marks, and requests for the bytes of those that differ."""
    held = []
    for b in batches:
        for kind, head in zip(b.column("kind").to_pylist(), b.column("head").to_pylist(), strict=True):
            if kind == MARKS:
                yield from _rows([*_deal(m := np.frombuffer(head, MARK), m["doc"], targets, MARKS)])
            else:
                held.append(np.frombuffer(head, SEGMENT))
    if not held:
        return
    kept, gone = combine(np.concatenate(held), length)
    held.clear()
    b = np.flatnonzero(np.concatenate([[True], kept["fp"][1:] != kept["fp"][:-1]]))
    n = np.diff(np.append(b, len(kept)))
    many = np.repeat(n, n)
    asked = kept[many > 1]
    r = np.zeros(len(asked), REQUEST)
    for c in ("fp", "doc", "lo", "anchor", "n"):
        r[c] = asked[c]
    r["hot"] = many[many > 1] > hot
    yield from _rows([*_deal(gone, gone["doc"], targets, MARKS), *_deal(r, r["doc"], targets, REQUESTS)])


def _dealt(batches: Iterator[pa.RecordBatch], targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents as rows of ROW, dealt like their marks."""
    for b in batches:
        ids = b.column(0).to_numpy()
        part = targets[(mix(ids.astype(_U), 77) % _U(len(targets))).astype(np.int64)]
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(n, TEXT), pa.int32()), b.column(0), pa.nulls(n, pa.binary()), b.column(1).cast(pa.binary())], ["target", "kind", "doc_id", "head", "body"])


def _documents(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[tuple[int, bytes, dict[int, np.ndarray]]]:
    """Rows sorted by kind, documents last -> each document with the entries of each kind that are its own."""
    held: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    found: dict[int, np.ndarray] = {}
    for b in batches:
        for kind, doc, head, body in zip(*(b.column(c).to_pylist() for c in ("kind", "doc_id", "head", "body")), strict=True):
            if kind != TEXT:
                held[kind].append(np.frombuffer(head, kinds[kind]))
                continue
            if not found:
                for k, t in kinds.items():
                    x = np.concatenate([np.zeros(0, t), *held.pop(k)])
                    found[k] = x[np.argsort(x["doc"], kind="stable")]
            yield doc, body or b"", {k: x[np.searchsorted(x["doc"], doc) : np.searchsorted(x["doc"], doc, "right")] for k, x in found.items()}


def _third(batches: Iterator[pa.RecordBatch], length: int, targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents and requests -> the segments' bytes, dealt by anchor or, for hot anchors, by core."""
    heads: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    bodies: list[np.ndarray] = []
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        head, key, body = np.concatenate(heads), np.concatenate(keys), np.concatenate(bodies)
        for x in (heads, keys, bodies):
            x.clear()
        part = (mix(key, 77) % _U(len(targets))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        size = head["size"].astype(np.int64)
        place = np.cumsum(size) - size
        part, head, size, place = part[order], head[order], size[order], place[order]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rows = []
        for b, e in zip(begins, [*begins[1:], len(part)], strict=True):
            n = size[b:e]
            at = np.repeat(place[b:e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((int(targets[part[b]]), SEGMENTS, None, head[b:e].tobytes(), body[at].tobytes()))
        return _rows(rows)

    for doc, text, entries in _documents(batches, {REQUESTS: REQUEST}):
        r = entries[REQUESTS]
        if not len(r):
            continue
        data = np.frombuffer(text, np.uint8)
        lo, n, key = r["lo"].astype(np.int64), r["n"].astype(np.int64), r["fp"]
        hot = r["hot"] > 0
        if hot.any():  # starts by their distance to the anchor, STEP to a core that all of them cover
            p = lo[hot] + r["anchor"][hot]
            parts = []
            for j in range(-(-(length - GRAM + 1) // STEP)):
                a, b = np.maximum(p - STEP * j - STEP + 1, lo[hot]), np.minimum(p - STEP * j, lo[hot] + n[hot] - 1)
                ok = a <= b
                parts.append((a[ok], (b - a + 1)[ok], (p - STEP * j)[ok]))
            a, m, core = (np.concatenate(x) for x in zip(*parts, strict=True))
            ck = span_hash(prefix_hash(data), core, core - STEP + 1 + length)
            lo, n, key = np.concatenate([lo[~hot], a]), np.concatenate([n[~hot], m]), np.concatenate([key[~hot], mix(ck, 11)])
        head = np.zeros(len(lo), PIECE)
        head["doc"], head["lo"], head["n"], head["size"] = doc, lo, n, n - 1 + length
        head["part"] = mix(key, 99) & _U(0xFFFF)
        size = n - 1 + length
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        heads.append(head)
        keys.append(key)
        bodies.append(data[at])
        held += len(at)
        if held > 4_000_000:
            yield from out()
            held = 0
    if held:
        yield from out()


def _fourth(batches: Iterator[pa.RecordBatch], length: int, targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All segments of some anchors or cores -> marks from their suffix array."""
    heads, bodies = [], []
    for b in batches:
        heads += [np.frombuffer(x, PIECE) for x in b.column("head").to_pylist()]
        bodies += [np.frombuffer(x, np.uint8) for x in b.column("body").to_pylist()]
    if not heads:
        return
    head, body = np.concatenate(heads), np.concatenate(bodies)
    del heads, bodies
    size = head["size"].astype(np.int64)
    place = np.cumsum(size) - size
    parts = len(body) // ARRAY_BYTES + 1
    for p in range(parts):
        own = np.flatnonzero(head["part"] % parts == p)
        if len(own):
            n = size[own]
            at = np.repeat(place[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            gone = repeats(head[own], body[at], length)
            yield from _rows([*_deal(gone, gone["doc"], targets, MARKS)])


def spans(doc: int, text: bytes, found: np.ndarray) -> np.ndarray:
    m = marks(found["doc"], found["start"], found["end"])
    return np.stack([m["start"], m["end"]], 1).astype(np.int64) if len(m) else np.zeros((0, 2), np.int64)


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        rows.clear()
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.uint64())
        columns = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].view(pa.int64())], ["doc_id", "starts", "ends", "kept", "text_hash"])

    size = 0
    for doc, text, entries in _documents(batches, {MARKS: MARK}):
        s = spans(doc, text, entries[MARKS])
        edges = [0, *s.ravel().tolist(), len(text)]
        kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        rows.append((doc, s[:, 0].tolist(), s[:, 1].tolist(), kept, xxhash.xxh64_intdigest(text, 42)))
        size += len(kept)
        if len(rows) >= 1000 or size > 4_000_000:
            yield out()
            size = 0
    if rows:
        yield out()


def even_targets(spark: SparkSession, n: int) -> np.ndarray:
    """A key for each of n partitions, such that hash partitioning sends the i-th to partition i."""
    found = spark.range(40 * n + 1000).select(F.col("id").cast("int").alias("k")).groupBy(F.expr(f"pmod(hash(k), {n})").alias("p")).agg(F.min("k").alias("k")).orderBy("p")
    return np.array([r["k"] for r in found.collect()], np.int64)  # a row for each partition


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, starts, ends (maximal removed runs, in bytes), kept (the other bytes) and text_hash
    (the whole text's, as Spark's xxhash64 gives it).

    Null or empty text: no bytes. doc_id names a document: repeated rows of one id and text count as one document and
    each get its row. Rows with a null doc_id are compared with nothing. Other columns are ignored. An empty table
    gives an empty result. `length` is 32 to 255.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    whole = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // PART_BYTES))
    targets = even_targets(spark, n)
    args = {"length": length, "targets": targets}
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    named = src.where("doc_id is not null")
    first = named.mapInArrow(functools.partial(_first, **args), ROW)
    second = scratch.table(first.repartition(n, "target").mapInArrow(functools.partial(_second, hot=hot, **args), ROW), "second")
    texts = named.mapInArrow(functools.partial(_dealt, targets=targets), ROW)
    asked = second.where(F.col("kind") == REQUESTS).unionByName(texts).repartition(n, "target").sortWithinPartitions("kind")
    found = asked.mapInArrow(functools.partial(_third, **args), ROW).repartition(n, "target").mapInArrow(functools.partial(_fourth, **args), ROW)
    found = scratch.table(found, "found")
    every = second.where(F.col("kind") == MARKS).unionByName(found).unionByName(texts).repartition(n, "target").sortWithinPartitions("kind")
    out = every.mapInArrow(_last, "doc_id long, starts array<long>, ends array<long>, kept binary, text_hash long")
    none = F.expr("cast(array() as array<bigint>)")
    return out.unionByName(src.where("doc_id is null").select("doc_id", none.alias("starts"), none.alias("ends"), F.col("text").alias("kept"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")))


def cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """UTF-8 text without the spans, which are first widened to whole characters."""
    out, done = [], 0
    for s, e in zip(starts, ends, strict=True):
        while s > 0 and s < len(text) and text[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        out.append(text[done : max(s, done)])
        done = max(e, done)
    return b"".join([*out, text[done:]])


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(at).to_pylist()
        starts, ends = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        new = [cut(t.encode(), s, e).decode() if t is not None and s else t for t, s, e in zip(texts, starts, ends, strict=True)]
        columns = b.columns[:-2]
        columns[at] = pa.array(new, b.column(at).type)
        yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-2])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100) -> DataFrame:
    """docs with the repeated passages cut out of `text_col`; a character of which a byte goes goes whole.

    Null texts and rows with a null id stay as they are. Repeated rows of an id and a text are cut alike. An id with
    several texts stands for the one whose hash is least; its other texts stay as they are. Columns may have any name.
    """
    i, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.where(i.isNotNull()).select(i.alias("doc_id"), text.alias("text")).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own = uuid.uuid4().hex  # names that docs doesn't have
    found = repeated_spans(one, length=length).where(F.size("starts") > 0)
    new = found.select(F.col("doc_id").alias(f"id_{own}"), F.col("text_hash").alias(f"hash_{own}"), F.col("starts").alias(f"starts_{own}"), F.col("ends").alias(f"ends_{own}"))
    joined = docs.where(i.isNotNull()).join(new.hint("merge"), (i == F.col(f"id_{own}")) & (F.xxhash64(text) == F.col(f"hash_{own}")), "left")
    spans = joined.select(*(F.col(f"`{c}`") for c in docs.columns), f"starts_{own}", f"ends_{own}")
    return spans.mapInArrow(functools.partial(_cut, at=docs.columns.index(text_col)), docs.schema).unionByName(docs.where(i.isNull()))
