"""Byte-level BPE, encoding and decoding.

Numpy cuts blocks of whole texts into words and numbers the distinct words of a block. The words of all blocks meet by
one shuffle, so each distinct word of the corpus is encoded once, by Spark's higher-order functions: a fold over its
bytes merges the leftmost pair of the lowest rank until no pair has a rank, and looks ranks up in a literal map. A
second shuffle takes the ids back to the blocks, where documents are lists of word numbers; decoding concatenates the
pieces of their ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import random
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files, tokenize
from .common import Scratch, distinct_spans, text_pieces

#: Bits of an id or rank, and of a place in a word, in the packed state of the fold.
ID, PLACE = 20, 8
NONE = (1 << ID) - 1
#: Words of more bytes are merged in Arrow batches with a heap: the fold takes a word's length squared.
LONG = 1 << (PLACE - 1)
#: Bytes of text in a block, unless one document has more.
BLOCK_BYTES = 36_000_000
#: Bits of a word's number in its block, of a block's number in its task; and of the tasks whose places of a word are
#: gathered together: a word is folded once for each such group.
WORD, BLOCK, CROWD = 28, 12, 9


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


@functools.lru_cache(maxsize=4)
def pieces_by_id(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def id_type(path: str) -> np.dtype:
    """How ids of words are packed."""
    return np.dtype(">u2" if len(pieces_by_id(path)) <= 1 << 16 else ">u4")


def packed(ids: Column, path: str) -> Column:
    """An array of ids as bytes, id_type each."""
    digits = 2 * id_type(path).itemsize
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), digits, "0")), ""))


def next_prime(n: int) -> int:
    return next(k for k in range(n | 1, 2 * n + 9, 2) if all(k % d for d in range(3, int(k**0.5) + 1, 2)))


@functools.lru_cache(maxsize=4)
def rank_tables(path: str) -> tuple[int, list[list[int]]]:
    """(factor, two tables): the pair (left, right) of rank r has the key left * factor + right, and is the entry
    (key << ID) + r at the place key % size in one of the tables; empty places hold -1."""
    ranks = read_ranks(path)
    factor = max(ranks.values()) + 1
    if factor > NONE:
        raise ValueError(f"ids of more than {ID} bits")
    entries = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                entries.append(((a * factor + b) << ID) + rank)
    size = next_prime(len(entries) + 16)
    sizes = (size, next_prime(size + 2))
    tables = [[-1] * n for n in sizes]
    r = random.Random(1)
    for e in entries:  # an entry that finds its place taken takes it, and the other moves to its second place
        k = 0
        while e >= 0:
            at = (e >> ID) % sizes[k]
            e, tables[k][at] = tables[k][at], e
            k = 1 - k if r.random() < 0.99 else k
    return factor, tables


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Ranks:
    """The rank map and the pieces of a rank file, as literals of a plan."""

    def __init__(self, path: str):
        self.factor, tables = rank_tables(path)
        self.sizes = [len(t) for t in tables]
        self.tables = F.from_json(F.lit(json.dumps(tables)), "array<array<bigint>>")
        ranks = read_ranks(path)
        by_id = {i: t.hex() for t, i in ranks.items()}
        self.pieces = F.split(F.lit(",".join(by_id.get(i, "") for i in range(self.factor))), ",")
        #: By signed byte value, from -128 on: its id.
        self.bytes = F.from_json(F.lit(json.dumps([ranks[bytes([b % 256])] for b in range(-128, 128)])), "array<bigint>")

    def rank(self, tables: Column, key: Column) -> Column:
        """The rank of the pair of ids whose key is left * factor + right; NONE if it has none. `key` is evaluated often."""
        shifted = key * (1 << ID)
        # what isn't the pair's own entry leaves less than 0 or more than NONE; without its sign the former is large too
        off = [(F.get(F.get(tables, F.lit(k)), (key % n).cast("int")) - shifted).bitwiseAND((1 << 63) - 1) for k, n in enumerate(self.sizes)]
        return F.least(*off, F.lit(NONE))

    def merge(self, word: Column) -> Column:
        """The ids of a word of signed bytes. The literal map stands in the plan once: tasks read it with the plan."""
        return bind(self.tables, lambda tables: self.folded(tables, word))

    def folded(self, tables: Column, word: Column) -> Column:
        """One merge at a time, the lowest rank first, from the left.

        The state has an entry for each piece: rank of the pair it opens, its place, its id, from the high bits to the
        low ones, so the least entry is the next merge.
        """
        one, low = 1 << ID, (1 << (ID + PLACE)) - 1
        none = F.lit(NONE << (ID + PLACE))

        def merged(s: Column, m: Column, p: Column) -> Column:
            """The entry m at place p (from 1 on) takes in the one after it."""
            made = F.shiftright(m, ID + PLACE)
            keys = F.array(F.get(s, p - 2).bitwiseAND(one - 1) * self.factor + made, made * self.factor + F.get(s, p + 1).bitwiseAND(one - 1))
            high = F.transform(keys, lambda k: self.rank(tables, k) * (low + 1))

            def entries(r: Column) -> Column:
                def entry(x: Column, k: Column) -> Column:
                    here = F.get(r, F.lit(1)) + m.bitwiseAND(low - (one - 1)) + made
                    return F.when((k < p - 2) | (k > p), x).when(k == p - 1, here).when(k == p - 2, F.get(r, F.lit(0)) + x.bitwiseAND(low))

                return F.filter(F.transform(s, entry), lambda x: x.isNotNull())

            return bind(high, entries)

        def step(s: Column, _: Column) -> Column:
            return bind(F.array_min(s), lambda m: F.when(m >= none, s).otherwise(bind(F.array_position(s, m).cast("int"), lambda p: merged(s, m, p))))

        def first(ids: Column) -> Column:
            keys = F.transform(ids, lambda i, k: i * self.factor + F.get(ids, k + 1))
            return F.zip_with(F.transform(keys, lambda k: self.rank(tables, k) * (low + 1)), F.transform(ids, lambda i, k: k * one + i), lambda a, b: a + b)

        ids = F.transform(word, lambda b: F.get(self.bytes, b.cast("int") + 128))
        folded = F.aggregate(F.sequence(F.lit(2), F.size(word)), bind(ids, first), step)
        done = F.when(F.size(word) < 2, ids).otherwise(folded)
        return F.transform(done, lambda x: x.bitwiseAND(one - 1).cast("int"))

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for: the pieces, one after another."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i.cast("int"))), ""))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word, with a heap of the pairs that can merge."""
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], right[i], alive[j] = stop, right[j], 0
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def pack_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of which small ones are frequent: a byte each, 255 for those whose rest stands in the second part."""
    small, packer = x < 255, zstandard.ZstdCompressor(level=1)
    planes = (x[~small] - 255).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of one significance lie together
    return packer.compress(np.where(small, x, 255).astype(np.uint8).tobytes()), packer.compress(planes)


def unpack_numbers(packed: tuple[bytes, bytes]) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    x = np.frombuffer(unpack.decompress(packed[0]), np.uint8).astype(np.int64)
    x[x == 255] += np.ascontiguousarray(np.frombuffer(unpack.decompress(packed[1]), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return x


def _split(batches: Iterator[pa.RecordBatch], path: str, folder: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (place, word, long): the distinct words of a block, frequent ones first, long ones with their ids; place is
    the block's number and the word's. The block's documents go into a file of the shared folder: ids, word counts and
    packed word numbers. Every attempt of a task writes a file of its own; a last row, after the words, names it and
    tells their number and digest, so whoever gathers the block knows that words and file belong together."""
    ranks = read_ranks(path)
    block = TaskContext.get().partitionId() << BLOCK
    known: dict[bytes, int] = {}
    held: list[tuple] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        often = np.bincount(np.concatenate([c for *_, c in held]), minlength=len(known)) if known else np.zeros(0, np.int64)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        if len(known) >= 1 << WORD or block >> BLOCK != TaskContext.get().partitionId():
            raise ValueError("too many words in a block, or blocks in a task")
        packs = [pack_numbers(rank[codes]) for *_, codes in held]
        kept = pa.table({"ids": pa.array([own for own, *_ in held], pa.list_(pa.int64())), "counts": pa.array([c for _, c, _ in held], pa.list_(pa.int64())), "small": [a for a, _ in packs], "rest": [b for _, b in packs]})
        with files.created(folder, f"block-{block}") as file, pa.ipc.new_stream(file.open(), kept.schema) as sink:
            sink.write_table(kept)
        words = list(known)
        words = [words[i] for i in order.tolist()]
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
            spelled = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(part), np.int8)))
            done = pa.array([np.array(merge_long(w, ranks), id_type(path)).tobytes() if len(w) > LONG else None for w in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((block << WORD) + np.arange(i, i + len(part))), spelled, done], ["place", "word", "long"])
        name = file.own.encode()
        last = json.dumps({"file": file.own, "digest": words_digest(b"".join(words), np.fromiter(map(len, words), np.int64, len(words)))}).encode()
        yield pa.RecordBatch.from_arrays([pa.array([(block << WORD) + len(words)], pa.int64()), pa.array([list(name)], pa.list_(pa.int8())), pa.array([last], pa.binary())], ["place", "word", "long"])

    for own, texts in text_pieces(batches):
        joined, cp, starts, ends, doc, hashes = tokenize.split([t.decode(errors="replace") for t in texts], True)
        first, which = distinct_spans(cp, starts, ends, hashes)
        words = [joined[s:e].encode() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        held.append((own, np.bincount(doc, minlength=len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64), number[which]))
        size += sum(map(len, texts))
        if size > block_bytes:
            yield from close()
            block, known, held, size = block + 1, {}, [], 0
    if held:
        yield from close()


def words_digest(spelled: bytes, sizes: np.ndarray) -> str:
    return hashlib.sha256(spelled + sizes.astype("<i8").tobytes()).hexdigest()


def _checked(block: int, numbers: np.ndarray, data: bytes, sizes: np.ndarray, path: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(file, ids of the words one after another, ids of each) of a block's gathered rows, the last of which is the
    file's. RuntimeError unless the ids decode to the very words that the file was written with."""
    kind, pieces = id_type(path), pieces_by_id(path)
    ends = len(data) - int(sizes[-1])
    flat, length = np.frombuffer(data[:ends], kind), sizes[:-1] // kind.itemsize
    try:
        said = json.loads(data[ends:])
    except ValueError:
        said = {}
    spelled = [pieces[i] for i in flat.tolist()]
    size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))])
    stops = np.cumsum(length)
    if (numbers != np.arange(len(sizes))).any() or said.get("digest") != words_digest(b"".join(spelled), size[stops] - size[stops - length]):
        raise RuntimeError(f"block {block}: words and file are of different runs; run the query again")
    return said["file"], flat, length


def _documents(folder: str, name: str, flat: np.ndarray, length: np.ndarray) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, ids of each) of a block, some at a time; flat, length: the ids of its words."""
    place = np.cumsum(length) - length
    with files.open_input(f"{folder}/{name}") as f:
        kept = pa.ipc.open_stream(f).read_all()
    for k in range(kept.num_rows):
        docs, counts = kept["ids"][k].as_py(), np.array(kept["counts"][k].as_py(), np.int64)
        codes = unpack_numbers((kept["small"][k].as_py(), kept["rest"][k].as_py()))
        ids, ends = tokenize.gather(flat, place[codes], length[codes]), np.cumsum(length[codes])
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        yield docs, np.split(ids, stops[:-1])


def lists(docs: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(docs), 100):
        part = ids[i : i + 100]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 100], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(part).astype(np.int32)))], ["doc_id", "ids"])


class Digests:
    """Number of ids, sha256 of the ids as text, and of the bytes decoded from them: the pieces, one after another."""

    DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __init__(self, path: str):
        self.path = path

    def __call__(self, docs: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_by_id(self.path)
        names = [str(i) for i in range(len(pieces))]
        rows = []
        for d, x in zip(docs, map(np.ndarray.tolist, ids), strict=True):
            said, raw = " ".join([names[i] for i in x]).encode(), b"".join([pieces[i] for i in x])
            rows.append((d, len(x), hashlib.sha256(said).hexdigest(), hashlib.sha256(raw).hexdigest()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _assemble(batches: Iterator[pa.RecordBatch], path: str, folder: str, finish: Callable[[list, list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Rows (place, ids) in order -> what `finish` makes of the documents."""
    block = None
    values: list[bytes] = []
    sizes: list[np.ndarray] = []
    numbers: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        name, flat, length = _checked(block, np.concatenate(numbers), b"".join(values), np.concatenate(sizes), path)
        for docs, ids in _documents(folder, name, flat, length):
            yield from finish(docs, ids)

    for b in batches:
        place = b.column("place").to_numpy()
        owner = place >> WORD
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        for s, e in zip(cuts, [*cuts[1:], len(owner)], strict=True):
            if owner[s] != block:
                if block is not None:
                    yield from out()
                block, values, sizes, numbers = int(owner[s]), [], [], []
            part = b.column("ids").slice(s, e - s)
            values.append(b"".join(part.to_pylist()))
            sizes.append(pa.compute.binary_length(part).to_numpy().astype(np.int64))
            numbers.append(place[s:e] & ((1 << WORD) - 1))
    if block is not None:
        yield from out()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, ids (array<int>), as the tiktoken library gives them for ordinary text; with
    `digest` what `Digests` makes of the ids instead.

    Every match of the pattern is encoded by itself, and words are told apart by their bytes. No special tokens. Null
    or empty text: no ids. Null doc_ids and repeated rows each get a row. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = Scratch(spark, "bpe").path("blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.mapInArrow(functools.partial(_split, path=path, folder=folder, block_bytes=block_bytes), "place long, word array<tinyint>, long binary")
    # a block names a word once, so a group holds no more places of it than CROWD tasks have blocks; ids are made before places are dealt out
    crowd = F.shiftright("place", BLOCK + WORD + CROWD).alias("crowd")
    words = rows.repartition(n, "word").groupBy("word", crowd, "long").agg(F.collect_list("place").alias("places"))
    made = words.select(F.coalesce("long", packed(Ranks(path).merge(F.col("word")), path)).alias("ids"), "places")
    ids = made.select(F.explode("places").alias("place"), "ids")
    finish, ddl = (Digests(path), Digests.DDL) if digest else (lists, "doc_id long, ids array<int>")
    return ids.repartition(n, F.shiftright("place", WORD)).sortWithinPartitions("place").mapInArrow(functools.partial(_assemble, path=path, folder=folder, finish=finish), ddl)
