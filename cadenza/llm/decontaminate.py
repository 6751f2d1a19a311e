"""Benchmark decontamination with an FM-index for each shard of training text.

A task cuts its documents into words and gathers them in shards of bounded size. A shard's words, in blocks that end
with a separator each, are sorted by suffix; the wavelet matrix of the transform answers rank queries. Windows of
benchmark words are searched backward, all windows of a batch at a time, places follow from sampled suffix positions,
and hits of a document merge into spans. Nothing is shuffled. The benchmark lies in a table of the shared folder that
tasks read batch by batch, so neither its size nor a document's decides how much memory a task takes.

Blocks overlap by a window less one word, so every window of a document lies in one block, and suffixes are told apart
within a block's length however many copies a shard holds.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import Scratch, distinct_spans, prefix_hash, span_hash, text_pieces

#: Symbols of a shard (its words and separators), words of a block, and distance of sampled suffix positions.
SHARD, BLOCK, SAMPLE = 1 << 19, 256, 16
#: Bytes of benchmark text that are searched together.
ITEM_BYTES = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_items: dict[str, list[Windows]] = {}


# --------------------------------------------------------------------------- words


def words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased texts, a blank after each; starts and ends of the words; words of each text)."""
    data = b" ".join([*texts, b""]).translate(_LOWER)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, starts, ends, np.diff(np.searchsorted(starts, stops), prepend=0)


def numbered(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, the number of each word), words being told apart by their bytes."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    first, which = distinct_spans(raw, starts, ends, span_hash(prefix_hash(raw), starts, ends))
    return [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], which


class Windows:
    """The different windows of a batch of items: rows of word numbers (-1 after a shorter item's end) and, window by
    window, the items that hold it."""

    def __init__(self, ids: list, texts: list[bytes], size: int):
        data, starts, ends, counts = words(texts)
        self.ids, (self.words, which) = ids, numbered(data, starts, ends)
        each = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
        item = np.repeat(np.arange(len(ids)), each)
        first = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        at = first[:, None] + np.arange(size)
        which = np.concatenate([which, [-1]])
        rows = np.where(at < counts[item][:, None], which[np.minimum(at + (np.cumsum(counts) - counts)[item][:, None], len(which) - 1)], -1)
        self.rows, group = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([group.ravel(), item]), axis=1)
        self.items, self.ends = pairs[1], np.cumsum(np.bincount(pairs[0], minlength=len(self.rows)))


def batches_of_items(folder: str, names: tuple[str, ...], size: int) -> Iterator[Windows]:
    """The benchmark, some at a time; one that fits into a batch is kept for the worker's next shards."""
    key = f"{folder}/{size}"
    if key in _items:
        yield from _items[key]
        return
    seen = []
    for name in names:
        with files.open_input(f"{folder}/{name}") as f:
            for ids, texts in text_pieces(pq.ParquetFile(f).iter_batches(batch_size=1024), most=ITEM_BYTES):
                seen = [*seen[-1:], Windows(ids, texts, size)]
                yield seen[-1]
    if len(seen) < 2:
        _items.clear()
        _items[key] = seen


# --------------------------------------------------------------------------- the index


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of all suffixes, sorted. s holds numbers below 2**21, and each block ends with one that no other place has.

    Three numbers decide first; groups of equal suffixes are then split by the rank of what follows, twice as far each
    round. A group never reaches beyond the end of its blocks.
    """
    n = len(s)
    far = np.concatenate([s, np.zeros(2, np.int64)])
    key = (far[:n] << 42) | (far[1 : n + 1] << 21) | far[2 : n + 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    single = new & np.concatenate([new[1:], [True]])
    at, h = np.flatnonzero(~single), 3
    while len(at):
        place, group = order[at], head[at]
        key = (group << 32) | rank[place + h]
        by = np.argsort(key, kind="stable")
        key, order[at] = key[by], place[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = head[at]
        at, h = at[~(new & np.concatenate([new[1:], [True]]))], 2 * h
    return order


class WaveletMatrix:
    """Ranks in a row of numbers: a level for each bit, from the highest on."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        x = values.astype(np.int32)
        for k in range(bits - 1, -1, -1):
            up = (x >> k) & 1
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(up, out=ones[1:])
            self.levels.append((k, ones, len(x) - int(ones[-1])))
            up = up.astype(bool)
            x = np.concatenate([x[~up], x[up]])
        #: Where a value's own places begin in the last arrangement.
        self.base = self.descend(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def descend(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ones, zeros in self.levels:
            up = ones[at]
            at = np.where((value >> k) & 1, zeros + up, at - up)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before its place."""
        return self.descend(value, at) - self.base[value]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the value at each place, how often it stands before)."""
        value = np.zeros(len(at), np.int64)
        for _, ones, zeros in self.levels:
            up = ones[at]
            bit = ones[at + 1] - up
            value, at = 2 * value + bit, np.where(bit == 1, zeros + up, at - up)
        return value, at - self.base[value]


class Index:
    """An FM-index of blocks of words: separators are symbol 0, words 1 and up."""

    def __init__(self, which: np.ndarray, lengths: np.ndarray, distinct: int):
        """which: word numbers of all blocks, one after another; lengths: words of each block."""
        blocks, n = len(lengths), len(which) + len(lengths)
        self.begin = np.cumsum(lengths + 1) - (lengths + 1)
        block = np.repeat(np.arange(blocks), lengths + 1)
        inside = np.arange(n) - self.begin[block]
        is_word = inside < lengths[block]
        symbols, sort = np.zeros(n, np.int64), block.copy()  # as numbers to sort by, separators differ and come first
        symbols[is_word], sort[is_word] = which + 1, which + blocks
        order = suffix_order(sort)
        counts = np.bincount(symbols, minlength=distinct + 1)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(symbols[order - 1], max(int(distinct).bit_length(), 1))
        sampled = (inside % SAMPLE == 0)[order]
        self.sampled, self.samples = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows of symbols (0: nothing, after the end) -> (rows that occur, low, high): suffixes [low, high) begin with them."""
        live = np.arange(len(rows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.starts[-1])
        for k in range(rows.shape[1] - 1, -1, -1):
            c, on = rows[live, k], rows[live, k] > 0
            lo, hi, c = low[live[on]], high[live[on]], c[on]
            low[live[on]], high[live[on]] = self.starts[c] + self.tree.rank(c, lo), self.starts[c] + self.tree.rank(c, hi)
            live = live[low[live] < high[live]]
        return live, low[live], high[live]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, place) of every suffix in the ranges: steps back lead to a sampled place."""
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        row = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[of]
        place, going, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(going):
            there = self.sampled[row + 1] > self.sampled[row]
            place[going[there]] = self.samples[self.sampled[row[there]]] + steps
            going, row, steps = going[~there], row[~there], steps + 1
            if len(going):
                value, before = self.tree.access(row)
                row = self.starts[value] + before
        return of, place


# --------------------------------------------------------------------------- documents


def blocks_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in it, words) of the blocks of documents of so many words; neighbours share size - 1 words."""
    step = BLOCK - size + 1
    each = np.where(counts == 0, 0, np.maximum(-(-(counts - size + 1) // step), 1))
    doc = np.repeat(np.arange(len(counts)), each)
    first = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * step
    return doc, first, np.minimum(counts[doc] - first, BLOCK)


def shards(data: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, size: int) -> Iterator[tuple[Index, list[bytes], np.ndarray, np.ndarray]]:
    """(index, its distinct words, document and first word of its blocks), with at most SHARD symbols each."""
    doc, first, lengths = blocks_of(counts, size)
    total, offset = np.cumsum(lengths + 1), np.cumsum(counts) - counts
    lo = 0
    while lo < len(doc):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SHARD, "right")), lo + 1)
        a, b = offset[doc[lo]] + first[lo], offset[doc[hi - 1]] + first[hi - 1] + lengths[hi - 1]
        base = int(starts[a])
        known, which = numbered(data[base : int(ends[b - 1])], starts[a:b] - base, ends[a:b] - base)
        at = offset[doc[lo:hi]] + first[lo:hi] - a
        n = lengths[lo:hi]
        places = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield Index(which[places], n, len(known)), known, doc[lo:hi], first[lo:hi]
        lo = hi


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, overlapping and touching ones joined."""
    by = np.lexsort((low, doc))
    doc, low, high = doc[by], low[by], high[by]
    if not len(doc):
        return doc, low, high
    far = int(high.max()) + 2
    reach = np.maximum.accumulate(high + doc * far)  # documents lie apart
    new = np.concatenate([[True], (low + doc * far)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], low[at], np.maximum.reduceat(high + doc * far, at) - doc[at] * far


def hits(data: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, items: tuple[str, tuple[str, ...]], size: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict[int, set]]:
    """(merged spans of words by document, ids of the items found in each document) of a batch of texts."""
    spans: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    found: dict[int, set] = {}
    for index, known, doc, first in shards(data, starts, ends, counts, size):
        symbol = {w: i + 1 for i, w in enumerate(known)}
        for w in batches_of_items(*items, size):
            mapped = np.array([*(symbol.get(x, -1) for x in w.words), 0], np.int64)
            own = mapped[w.rows]
            there = np.flatnonzero((own >= 0).all(axis=1))
            live, low, high = index.search(own[there])
            of, place = index.locate(low, high)
            window = there[live][of]
            block = np.searchsorted(index.begin, place, "right") - 1
            at, begin = doc[block], first[block] + place - index.begin[block]
            spans.append((at, begin, begin + (w.rows[window] >= 0).sum(axis=1)))
            for d, x in np.unique(np.stack([at, window]), axis=1).T.tolist():
                found.setdefault(d, set()).update(w.ids[i] for i in w.items[w.ends[x - 1] if x else 0 : w.ends[x]].tolist() if w.ids[i] is not None)
    return merged(*(np.concatenate(c) for c in zip(*spans, strict=True))), found


def _search(batches: Iterator[pa.RecordBatch], items: tuple[str, tuple[str, ...]], size: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_pieces(batches):
        data, starts, ends, counts = words(texts)
        (doc, low, high), found = hits(data, starts, ends, counts, items, size)
        offset, begin = np.cumsum(counts) - counts, np.cumsum([0, *(len(t) + 1 for t in texts)])
        a, b = starts[offset[doc] + low] - begin[doc], ends[offset[doc] + high - 1] - begin[doc]
        n_spans = np.bincount(doc, minlength=len(ids))
        n_hit = np.bincount(doc, weights=high - low, minlength=len(ids)).astype(np.int64)
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
        cols = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(n_hit), pa.array([sorted(found.get(d, ())) for d in range(len(ids))], pa.list_(pa.string())), places]
        names = ["doc_id", "n_words", "n_hit", "items", "spans"]
        if with_text:
            cols.append(pa.array([without(t, s) for t, s in zip(texts, places.to_pylist(), strict=True)], pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(cols, names)


def without(text: bytes, spans: list[dict]) -> str:
    cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, size: int = 10, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, and with `with_text` kept.

    A window is `size` consecutive words of an item, or a shorter item whole; words are runs of ASCII digits, letters
    (case ignored) and characters beyond ASCII. n_hit counts the document's words inside occurrences of windows, items
    lists the ids, as sorted strings, of items of which a window occurs, spans are the merged bytes from the first to
    the last word of such runs, kept is the text without them. Null texts have no words; items without words are found
    nowhere; items with a null id hit words but are listed nowhere, and repeated items count once. Null doc_ids and
    repeated rows each get a row. Texts are searched whole, however long. Other columns are ignored, whatever their
    names. An empty benchmark hits nothing; an empty table gives an empty result.
    """
    if not 0 < size < BLOCK:
        raise ValueError(f"size must be above 0 and below {BLOCK}")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.table(benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "items")
    held = (items._scratch_path, tuple(sorted(f.rpartition("/")[2] for f in items.inputFiles())))
    ddl = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>" + ", kept string" * with_text
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(functools.partial(_search, items=held, size=size, with_text=with_text), ddl)
