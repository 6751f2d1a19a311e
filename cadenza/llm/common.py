"""What the operators of this subpackage share: shared-folder tables, text batches, hashing and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document forms a pass of its own.
PIECE_BYTES = 2_000_000


# --------------------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


class Scratch:
    """Tables and folders of one operator call, in the shared folder, so that a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns it as read back: cuts the lineage."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._scratch_path)
            p.getFileSystem(conf).delete(p, True)


# --------------------------------------------------------------------------- batches of texts


def text_pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES, docs: int = 4096) -> Iterator[tuple[list, list[bytes], list[pa.RecordBatch]]]:
    """(ids, UTF-8 texts) of at most `most` bytes or one document; the columns are id and text, in this order. Null texts are empty."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            if ids and (size + len(t) > most or len(ids) >= docs):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
    if ids:
        yield ids, texts


def as_batches(table: pa.Table, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def binary_array(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in data."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    buf = pa.py_buffer(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), buf]).cast(pa.binary())


# --------------------------------------------------------------------------- hashing in numpy

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ _U(salt)
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, _U)
            p[1:] = _U(base)
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with span_hash(P, s, e) a function of the bytes data[s:e] alone; len(data) + 1 values."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))


def spans_equal(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Whether a[a_start : + size] and b[b_start : + size] hold the same values, for every span (size 1 at least)."""
    same = np.ones(len(size), bool)
    if not len(size):
        return same
    ends = np.cumsum(size)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), step), "right")).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(size)], strict=True):
        n = size[lo:hi].astype(np.int64)
        first = np.cumsum(n) - n
        total = int(n.sum())
        for k in range(0, total, 8 * step):  # one span may be longer than a step
            at = np.arange(k, min(k + 8 * step, total))
            owner = np.repeat(np.arange(len(n)), n)[k : k + 8 * step] if total <= 8 * step else np.searchsorted(first, at, "right") - 1
            differ = a[(a_start[lo:hi] - first)[owner] + at] != b[(b_start[lo:hi] - first)[owner] + at]
            same[lo + owner[differ]] = False
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of equal spans, group of every span): hashes only sort, the values decide."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, of = ends - starts, first[which]
    odd = size != size[of]
    even = np.flatnonzero(~odd & (of != np.arange(len(of))))
    if len(even):
        odd[even[~spans_equal(data, starts[even], data, starts[of[even]], size[even])]] = True
    if odd.any():  # spans whose hash another span has
        known: dict[bytes, int] = {}
        extra: list[int] = []
        for i in np.flatnonzero(odd).tolist():
            value = data[starts[i] : ends[i]].tobytes()
            if value not in known:
                known[value] = len(first) + len(extra)
                extra.append(i)
            which[i] = known[value]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, which


# --------------------------------------------------------------------------- joins with hot keys

#: Slices of a hot key's rows.
SLICES = 32


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], copies: str, rows: int) -> DataFrame:
    """left join right (one row for each key) where a key may have a large share of left's `rows` rows.

    `copies` is right's column of how many rows of left its key has. Keys with more than a share of 1 / (8 x shuffle
    partitions) of them are no more than that many, so they may be broadcast; their rows are dealt to SLICES slices.
    """
    most = 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(right.where(F.col(copies) * most > max(rows, most)).select(*keys, F.lit(True).alias("__hot")))
    a = left.join(hot, keys, "left").withColumn("__slice", F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SLICES))).otherwise(0).cast("int"))
    slices = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(hot, keys, "left").withColumn("__slice", F.explode(slices)).drop("__hot", copies)
    return a.drop("__hot").join(b.hint("merge"), [*keys, "__slice"], "left").drop("__slice")


# --------------------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b: long) -> (id, component): the smallest id that can be reached, for every id on an edge.

    Each round hooks every vertex to its smallest neighbour, follows the hooks twice and contracts the edges; only
    minima are aggregated, so a vertex with very many neighbours is combined before the shuffle. Nulls and loops are
    left out; no edges give an empty table.
    """
    e = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = scratch.table(hook, "hook")
        jumped = hook
        for _ in range(2):
            jumped = jumped.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        jumped = scratch.table(jumped, "jump")
        if found is None:
            found = jumped.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            found = found.join(jumped.select(F.col("u").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        found = scratch.table(found, "found")
        left = e.join(jumped.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(jumped.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        nxt = scratch.table(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        scratch.drop(e, hook)
        e = nxt
        if e.isEmpty():
            return found
