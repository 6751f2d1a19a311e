"""Near-duplicate vectors by random-hyperplane sign hashing in several tables, exact cosines and connected components.

Equal vectors of one label are one class. A table's key is the label and some signs; classes that share a key form
blocks, in which matrix products give exact cosines. A pair counts in the first table that brings it together, so link
counts are sums over blocks; each block also yields a spanning forest of its links. The signs of a key follow the number
of different vectors of its label, so a vector meets a bounded number of strangers in a table however large the label;
the tables follow the signs, so a pair at the threshold is missed with the same probability in labels of every size.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_batches, connected_components, join_spread, mix
from .minhash import _buckets, _groups, distinct_blocks

#: Least and most signs of a key, and the probability with which a pair at the threshold shares none.
LEAST_BITS, MOST_BITS, MISS = 14, 40, 5e-7
#: Further signs of a vector, and the probability with which linked vectors differ in too many of them.
SKETCH, SKETCH_MISS = 128, 1e-10
#: Members up to which a bucket is compared by sketch; larger ones go on whole.
SMALL = 16
_U = np.uint64
_planes: dict[tuple[int, int], np.ndarray] = {}


def bits(members: int) -> int:
    """Signs of a key in a label of so many vectors: in a table, a quarter of a stranger for each vector."""
    return min(max(math.ceil(math.log2(max(members, 1))) + 2, LEAST_BITS), MOST_BITS)


def tables(n_bits: int, least: float) -> int:
    """The fewest tables in which vectors at cosine `least` share no key with probability MISS at most."""
    same = min(1 - math.acos(min(least, 1.0)) / math.pi, 1 - 1e-9) ** n_bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-same)))


def differ(least: float) -> int:
    """The fewest signs of SKETCH that vectors at cosine `least` exceed in differences with probability SKETCH_MISS at most."""
    q, tail, d = math.acos(min(least, 1.0)) / math.pi, 0.0, SKETCH
    while d and (tail := tail + math.comb(SKETCH, d) * q**d * (1 - q) ** (SKETCH - d)) <= SKETCH_MISS:
        d -= 1
    return d


def planes(size: int, count: int) -> np.ndarray:
    """Integer-valued normal vectors: products with scaled components are exact, so signs never depend on the batch."""
    if (size, count) not in _planes:
        _planes[size, count] = np.rint(np.random.default_rng(20240601 + size).standard_normal((size, count)) * 256)
    return _planes[size, count]


def first_keys(v: np.ndarray, n_bits: int, n_tables: int, upto: int) -> np.ndarray:
    """n x upto: the keys of signs() in the first tables alone."""
    keys, normals = np.zeros((len(v), upto), np.int64), planes(v.shape[1], n_bits * n_tables + SKETCH)[:, : n_bits * upto]
    for i in range(0, len(v), 1000):
        part = v[i : i + 1000]
        found = np.rint(part / np.sqrt((part * part).sum(1, keepdims=True)) * 2.0**20) @ normals >= 0
        for j in range(n_bits):
            keys[i : i + 1000] |= found[:, j::n_bits].astype(np.int64) << j
    return keys


def signs(v: np.ndarray, n_bits: int, n_tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x n_tables keys of n_bits signs, n x 2 words of the sketch)."""
    keys, sketch = np.zeros((len(v), n_tables), np.int64), np.zeros((len(v), SKETCH // 64), np.int64)
    normals, cut = planes(v.shape[1], n_bits * n_tables + SKETCH), n_bits * n_tables
    for i in range(0, len(v), 1000):
        part = v[i : i + 1000]
        found = np.rint(part / np.sqrt((part * part).sum(1, keepdims=True)) * 2.0**20) @ normals >= 0
        for j in range(n_bits):
            keys[i : i + 1000] |= found[:, j:cut:n_bits].astype(np.int64) << j
        sketch[i : i + 1000] = np.packbits(found[:, cut:], axis=1).view(np.int64)
    return keys, sketch


def _unit_safe(values: list | None) -> bytes | None:
    """The vector's doubles; None if it links with nothing."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, "<f8")
    with np.errstate(over="ignore", under="ignore"):
        top = np.abs(v).max() if np.isfinite(v).all() else 0.0
    return v.tobytes() if top > 0 else None


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, labels, values = (b.column(i).to_pylist() for i in range(3))
        rows = []
        for i, x, v in zip(ids, labels, values, strict=True):
            raw = _unit_safe(v) if x is not None and i is not None else None
            h = struct.unpack("<qq", xxhash.xxh3_128_digest(raw + x.encode())) if raw else (None, None)
            rows.append((i, *h, x if raw else None, raw))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["vec_id", "h1", "h2", "label", "vec"])


def matrix(raw: list[bytes]) -> np.ndarray:
    """Scaled by a power of two first, so that squares neither overflow nor vanish."""
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _keys(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(label, members, vec_id, vec) -> a row for each table; `band` is the number of signs x 65536 + the table."""
    for b in batches:
        raw, ids = b.column("vec").to_pylist(), b.column("vec_id").to_numpy()
        labels = np.array([xxhash.xxh64_intdigest(x) for x in b.column("label").to_pylist()], _U)
        sizes, n_bits = np.array([len(x) for x in raw]), np.array([bits(n) for n in b.column("members").to_pylist()])
        for size, n in sorted(set(zip(sizes.tolist(), n_bits.tolist(), strict=True))):
            t = tables(n, least)
            at = np.flatnonzero((sizes == size) & (n_bits == n))
            for part in np.array_split(at, -(-len(at) // 1000)):
                s, sketch = signs(matrix([raw[i] for i in part]), n, t)
                h = mix(labels[part] + _U(size))
                key = mix(mix(h[:, None] + s.astype(_U)) + np.arange(t, dtype=_U)[None, :]).view(np.int64)
                band = np.tile(n * 65536 + np.arange(t, dtype=np.int32), len(part)).astype(np.int32)
                yield from as_batches(pa.table({"key": key.ravel(), "band": band, "doc_id": np.repeat(ids[part], t), "s0": np.repeat(sketch[:, 0], t), "s1": np.repeat(sketch[:, 1], t)}), 100_000)


def _live(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> those with a partner of the same key whose sketch is near; large buckets stay whole."""
    held: pa.Table | None = None

    def near(t: pa.Table) -> pa.RecordBatch:
        key, s0, s1 = t.column("key").to_numpy(), *(t.column(c).to_numpy().view(_U) for c in ("s0", "s1"))
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begins, len(key)))
        alive = np.repeat(size > SMALL, size)
        for o in range(1, int(min(size.max(), SMALL))):
            x = np.flatnonzero(key[:-o] == key[o:])
            x = x[np.bitwise_count(s0[x] ^ s0[x + o]).astype(np.int16) + np.bitwise_count(s1[x] ^ s1[x + o]) <= most]
            alive[x] = alive[x + o] = True
        return t.select(["key", "band", "doc_id"]).filter(pa.array(alive)).combine_chunks()

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) < 100_000:
            continue
        key = held.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut:
            yield from near(held.slice(0, cut)).to_batches()
            held = held.slice(cut)
    if held is not None and len(held):
        yield from near(held).to_batches()


def _candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    return _buckets(_live(batches, most))


def links(v: np.ndarray, weight: np.ndarray, left: np.ndarray, cross: bool, band: int, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weight of the partners that each vector of a block links with in this table first, edges of a spanning forest)."""
    n_bits, table = divmod(band, 65536)
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    count, edges, label = np.zeros(len(v), np.int64), [], np.arange(len(v))
    sig = np.zeros((len(v), table), np.int64)  # of the vectors met so far that have a link
    known = np.zeros(len(v), bool)
    for i in range(0, len(v), 512):
        rows = np.arange(i, min(i + 512, len(v)))
        ok = (unit[rows] @ unit.T >= least) & (rows[:, None] < np.arange(len(v))[None, :])
        if cross:
            ok &= left[rows][:, None] != left[None, :]
        if not ok.any():
            continue
        linked = ok.any(0)
        linked[rows] |= ok.any(1)
        if table and len(new := np.flatnonzero(linked & ~known)):
            sig[new], known[new] = first_keys(v[new], n_bits, tables(n_bits, least), table), True
        x, y = np.nonzero(ok)
        x += i
        for c in range(0, len(x), 100_000):
            a, b = x[c : c + 100_000], y[c : c + 100_000]
            early = np.zeros(len(a), bool)
            for t in range(table):
                early |= sig[a, t] == sig[b, t]
            a, b = a[~early], b[~early]
            count += np.bincount(a, weight[b], len(v)).astype(np.int64) + np.bincount(b, weight[a], len(v)).astype(np.int64)
            while (open_ := label[a] != label[b]).any():
                a, b = a[open_], b[open_]
                edges.append((int(a[0]), int(b[0])))
                label[label == label[b[0]]] = label[a[0]]
    return count, edges


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        ids = t.column("vec_id").to_numpy()
        count, edges = links(matrix(t.column("vec").to_pylist()), t.column("n").to_numpy(), t.column("is_left").to_numpy(), t.column("cross")[0].as_py(), t.column("band")[0].as_py(), least)
        some = np.flatnonzero(count)
        a = np.concatenate([ids[some], ids[[e[0] for e in edges]]]) if edges else ids[some]
        b = np.concatenate([ids[some], ids[[e[1] for e in edges]]]) if edges else ids[some]
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(np.concatenate([count[some], np.zeros(len(edges), np.int64)]), pa.int64())})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label are linked by a cosine of at least `least` in double precision. A null or empty
    vector, one of zeros, with null or non-finite components, without label or without id links with nothing. Vectors
    of different length don't link. `least` is above 0; tables and sketch follow it. Repeated rows are vectors of their own and link with each other. Other columns are
    ignored. An empty table gives an empty result.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    scratch = Scratch(vectors.sparkSession, "vectors")
    src = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>"))
    rows = scratch.table(src.mapInArrow(_prepare, "vec_id long, h1 long, h2 long, label string, vec binary"), "rows")
    classes = rows.where("vec is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("vec").alias("vec"))
    classes = scratch.table(classes, "classes")
    # the vectors of each label and length, joined with hot labels in slices
    sized = classes.select("vec_id", "vec", "label", F.octet_length("vec").alias("size"))
    members = sized.groupBy("label", "size").agg(F.count("*").alias("copies")).withColumn("members", F.col("copies"))
    sized = join_spread(sized, members, ["label", "size"], "copies", classes.count()).select("label", "members", "vec_id", "vec")
    keyed = sized.mapInArrow(functools.partial(_keys, least=least), "key long, band int, doc_id long, s0 long, s1 long").repartition("key").sortWithinPartitions("key")
    blocks = distinct_blocks(keyed.mapInArrow(functools.partial(_candidates, most=differ(least)), "band int, members array<long>, left int"), scratch)
    members = blocks.select("gid", "band", "left", F.posexplode("members").alias("at", "vec_id")).select("gid", "band", "vec_id", (F.col("at") < F.col("left")).alias("is_left"), (F.col("left") > 0).alias("cross"))
    found = members.join(classes.select("vec_id", "n", "vec"), "vec_id").repartition("gid").sortWithinPartitions("gid").mapInArrow(functools.partial(_verify, least=least), "a long, b long, links long")
    found = scratch.table(found, "found")
    component = connected_components(found.select("a", "b"), scratch).select(F.col("id").alias("vec_id"), "component")
    count = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "vec_id", "n").join(component, "vec_id", "left").join(count, "vec_id", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "vec_id").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
