"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids, little-endian, 2 or 4 bytes each), then a skippable frame with the
documents' ids, then the seek table in the public seekable format: a skippable frame of (compressed size, size,
checksum) for each frame and a footer. Readers find a document through the directory and decompress its frame alone.
"""

from __future__ import annotations

import functools
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, tokenize
from .common import Scratch, text_pieces

#: Fixed values of the seekable format.
SKIPPABLE, DIRECTORY, FOOTER, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80


def width(largest: int) -> int:
    """Bytes of an id in files whose ids go up to `largest`."""
    return 2 if largest < 1 << 16 else 4


class Writer:
    """Frames into a file; width: bytes of an id."""

    def __init__(self, out: BinaryIO, width: int = 2, level: int = 3):
        self.out, self.width, self.table = out, width, []
        self.docs: list[int | None] = []
        self.packer = zstandard.ZstdCompressor(level=level)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {ids.max()} doesn't fit into {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append(doc_id)

    def close(self) -> None:
        n = len(self.docs)
        known = np.array([d is not None for d in self.docs], np.uint8).tobytes()
        packed = self.packer.compress(struct.pack("<BI", self.width, n) + np.array([d or 0 for d in self.docs], "<i8").tobytes() + known)
        self.out.write(struct.pack("<II", DIRECTORY, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", n, CHECKSUMS, FOOTER))


class Reader:
    """Documents of a seekable file by place or id."""

    def __init__(self, source: BinaryIO):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * n - 8)
        head = source.read(8 + 12 * n)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(head[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        frames = int(self.table[:, 0].sum())
        source.seek(frames)
        magic, length = struct.unpack("<II", source.read(8))
        if magic != DIRECTORY:
            raise ValueError("the directory is missing")
        self.unpacker = zstandard.ZstdDecompressor()
        d = self.unpacker.decompress(source.read(length - 4))
        self.width, count = struct.unpack("<BI", d[:5])
        known = np.frombuffer(d, np.uint8, count, 5 + 8 * count)
        self.docs = [i if k else None for i, k in zip(np.frombuffer(d, "<i8", count, 5).tolist(), known, strict=True)]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; its frame alone is read."""
        packed, size, checksum = self.table[k].tolist()
        self.source.seek(int(self.starts[k]))
        raw = self.unpacker.decompress(self.source.read(packed), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> list[np.ndarray]:
        return [self.ids(k) for k, d in enumerate(self.docs) if d == doc_id]


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, kind: str, end: int) -> Iterator[pa.RecordBatch]:
    last, total, docs = np.array([end], np.uint32), 0, 0
    with files.created(folder, "ids") as made:
        writer = None
        for ids, texts in text_pieces(batches):
            flat, counts = tokenize.encode([t.decode() for t in texts], tokenizer, kind)
            writer = writer or Writer(made.open(), width(max(tokenize.largest_id(tokenizer, kind), end)))
            for i, x in zip(ids, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                writer.add(i, np.concatenate([x, last]))
            total += len(flat) + len(ids)
            docs += len(ids)
        if writer is not None:
            writer.close()
    if docs:
        yield pa.RecordBatch.from_pydict({"path": [made.path], "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "docs": [docs], "tokens": [total]})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            with files.open_input(path) as f:
                r = Reader(f)
                n = r.table[:, 1] // r.width
                crc = [zlib.crc32(r.ids(k).astype("<u4").tobytes()) for k in range(len(r.docs))]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r.docs, pa.int64()), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, kind: str = "byte", end: int = 0) -> DataFrame:
    """Writes the documents' ids in ascending id order, a file for each range of ids; returns the lazy manifest
    (path, part, docs, tokens): materialise it once, then only files that it lists count."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # rows of one id are dealt and ordered by their texts
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(functools.partial(_write, folder=folder, tokenizer=tokenizer, kind=kind, end=end), "path string, part long, docs long, tokens long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32. The running sum is over files, not
    documents, and the files are dealt to tasks evenly."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, kind: str = "byte", end: int = 0) -> DataFrame:
    """Writes the files into the shared folder and reads them back: a row per document.

    Null or empty text: the end id alone. Null doc_ids come first. Repeated rows each have a frame. Other columns are
    ignored. An empty table writes no file and gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "tokenids")
    manifest = scratch.table(write_ids(docs, scratch.path("files"), tokenizer, id_col, text_col, kind=kind, end=end), "manifest")
    return read_ids(manifest)
