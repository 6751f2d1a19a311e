"""Packing of tokenised documents into sequences by bin completion.

Lengths are at most the capacity, so their histogram has a bounded size whatever the corpus: the driver plans on it.
The plan is a branch and bound over sequences: best-fit decreasing is the incumbent, dual feasible functions bound the
number of sequences from below, and branches complete the largest length left with undominated fillings, repeated as
the counts allow. It ends when the incumbent meets the bound, when no branch is left, or after WORK steps; then the
incumbent stands, which is never worse than best-fit decreasing. Every piece then finds its place from its rank among
the pieces of its length; ranks are counted by (length, block of documents), so that a length which very many copies
share is spread over the blocks.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenize
from .common import Scratch, text_pieces

#: Steps (a node and a filling count the distinct lengths left and STEP more) after which the search over sequences ends undecided; the
#: first dive is finished in any case.
WORK, STEP = 3_000_000, 60
#: Bounding functions that every node evaluates.
BOUNDS = 24


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing, equal sequences together: [(lengths, how often)]."""
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    for x in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        n = histogram[x]
        while n:
            # the least room that fits; the piece after it goes there too as long as it fits
            room = min((r for r in rooms if r >= x), default=capacity)
            pattern, times = rooms[room].pop() if room in rooms else ([], n)
            if room in rooms and not rooms[room]:
                del rooms[room]
            each = min(room // x, n)
            full = min(times, n // each)
            n -= full * each
            rooms.setdefault(room - each * x, []).append((pattern + [x] * each, full))
            if pattern and times > full:
                rooms.setdefault(room, []).append((pattern, times - full))
    return [p for parts in rooms.values() for p in parts]


def bounding(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual feasible functions of the lengths, a row each, and the size of a sequence by row: the sum of a row over
    all pieces, by that size and rounded up, is a lower bound on the number of sequences."""
    rows, sizes = [lengths], [capacity]
    for k in range(1, 33):
        rows.append(np.where((k + 1) * lengths % capacity == 0, lengths * k, capacity * ((k + 1) * lengths // capacity)))
        sizes.append(capacity * k)
    for e in lengths[lengths * 2 <= capacity]:
        rows.append(np.where(lengths > capacity - e, capacity, np.where(lengths < e, 0, lengths)))
        sizes.append(capacity)
    return np.stack(rows).astype(np.int64), np.array(sizes, np.int64)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    rows, sizes = bounding(lengths, capacity)
    n = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    return int((-(-(rows @ n) // sizes)).max(initial=0))


def fillings(room: int, lengths: list[int], counts: list[int]) -> Iterator[dict[int, int] | None]:
    """The undominated fillings of `room` as {length: pieces}, from `lengths` (ascending) with counts above 0; least
    waste first, then the largest pieces first. None stands for each dominated one, so that callers can count them.

    reach[i] has bit s if pieces of the first i lengths can fill s exactly, so no branch of the enumeration is dead.
    A filling is dominated if a piece left out could replace some of its pieces (or none) that are together no larger:
    those fit wherever the piece would have gone.
    """
    mask, have = (1 << (room + 1)) - 1, dict(zip(lengths, counts, strict=True))
    every = sum(1 << x for x in lengths)
    reach, r = [1], 1
    for x, n in zip(lengths, counts, strict=True):
        n = min(n, room // x)
        new, k = r, 1
        while n > 0 and r != mask:
            new |= new << (x * min(k, n)) & mask
            n, k = n - k, 2 * k
        r = r if new == r else new
        reach.append(r)

    def exact(total: int, upto: int) -> Iterator[dict[int, int]]:
        if not total:
            yield {}
            return
        for i in range(bisect_right(lengths, total, 0, upto) - 1, -1, -1):
            x = lengths[i]
            if not reach[i + 1] >> total & 1:
                return
            for k in range(min(counts[i], total // x), 0, -1):
                if reach[i] >> (total - k * x) & 1:
                    for rest in exact(total - k * x, i):
                        yield {x: k, **rest}

    def dominated(filling: dict[int, int], waste: int) -> bool:
        left = every
        for x, n in filling.items():
            if have[x] == n:
                left &= ~(1 << x)
        some, several = 1, 0
        for x, n in filling.items():
            for _ in range(n):
                several |= (some & ~1 | several) << x
                some |= some << x
        if left & several:
            return True
        near, width = some << 1, 1  # sums that are 1 to `width` smaller
        while width < waste:
            step = min(width, waste - width)
            near, width = near | near << step, width + step
        return bool(waste and left & near)

    while r:
        total = r.bit_length() - 1
        r &= ~(1 << total)
        for filling in exact(total, len(lengths)):
            yield None if dominated(filling, room - total) else filling


def search(histogram: dict[int, int], capacity: int, work: int = WORK) -> tuple[list[tuple[list[int], int]], int, bool]:
    """(patterns, lower bound, whether the number of sequences is known to be the least).

    Branch and bound over sequences, with best-fit decreasing as the first incumbent. A node takes the largest length
    left; its branches are the undominated fillings beside it, each repeated as often as the counts allow, half as
    often, and so on down to once, so that every solution of undominated fillings is reached. A branch goes if its
    sequences and the bound on the rest are no fewer than the incumbent's, or if its counts were met with no more
    sequences. Dives follow first branches; those with fewest other branches come first, and of these the earliest.
    """
    lengths = sorted(k for k, v in histogram.items() if v > 0)
    if not lengths:
        return [], 0, True
    start = np.array([histogram[x] for x in lengths], np.int64)
    place = {x: i for i, x in enumerate(lengths)}
    best = best_fit(histogram, capacity)
    most = sum(t for _, t in best)
    rows, sizes = bounding(np.array(lengths, np.int64), capacity)
    bounds = -(-(rows @ start) // sizes)
    least = int(bounds.max())
    keep = np.unique(np.concatenate([np.arange(9), np.argsort(-((rows @ start) / sizes), kind="stable")[:BOUNDS]]))
    rows, sizes = rows[keep], sizes[keep]
    met = {start.tobytes(): 0}
    serial, dived = itertools.count(), False
    heap: list[tuple] = [(0, next(serial), start, 0, None, 0)]

    def branches(state: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[int]] | None]:
        live = np.flatnonzero(state).tolist()
        top, beside = live[-1], state.copy()
        beside[top] -= 1
        pool = [i for i in live if beside[i]]
        for filling in fillings(capacity - lengths[top], [lengths[i] for i in pool], beside[pool].tolist()):
            if filling is None:
                yield None
                continue
            need = {lengths[top]: 1, **filling}
            if lengths[top] in filling:
                need[lengths[top]] = filling[lengths[top]] + 1
            at, n = np.array([place[x] for x in need]), np.array(list(need.values()), np.int64)
            times = int((state[at] // n).min())
            pattern = [x for x, k in need.items() for _ in range(k)]
            while times:
                after = state.copy()
                after[at] -= n * times
                yield after, times, pattern
                times //= 2

    while heap and most > least:
        others, _, state, used, trail, skip = heapq.heappop(heap)
        while True:
            if work < 0 and dived:
                return best, least, False
            step = STEP + int(np.count_nonzero(state))
            work -= step * (skip + 1)
            if used + int((-(-(rows @ state) // sizes)).max()) >= most:
                dived = True
                break
            branch = None
            for branch in itertools.islice(branches(state), skip, None):
                skip, work = skip + 1, work - step
                if branch is not None:
                    break
                if work < 0 and dived:
                    return best, least, False
            if branch is None:
                break
            heapq.heappush(heap, (others + 1, next(serial), state, used, trail, skip))
            after, times, pattern = branch
            state, used, trail, skip = after, used + times, (trail, pattern, times), 0
            if not state.any():
                dived = True
                if used < most:
                    most, best = used, []
                    while trail:
                        trail, pattern, times = trail
                        best.append((pattern, times))
                    best.reverse()
                break
            key = state.tobytes()
            if met.get(key, used + 1) <= used:
                break
            met[key] = used
    return best, least, True


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, largest first; how often)] for pieces of 1 to capacity."""
    return search(histogram, capacity)[0]


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (rank of the first piece, sequence of that piece, offset), ranks ascending."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            out.setdefault(x, []).append((ranks.get(x, 0), base, offset))
            ranks[x] = ranks.get(x, 0) + times
            offset += x
        base += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, kind: str, end: int, capacity: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """The pieces, dealt to blocks in turn: copies of a row too are spread over the blocks."""
    serial = 0
    for ids, texts in text_pieces(batches):
        flat, counts = tokenize.encode([t.decode() for t in texts], tokenizer, kind)
        rows: list[tuple] = []
        at = 0
        for i, n in zip(ids, counts.tolist(), strict=True):
            x = np.append(flat[at : at + n], end).astype("<u4")
            at += n
            for p, s in enumerate(range(0, len(x), capacity)):
                part = x[s : s + capacity]
                rows.append((i, p, s, len(part), zlib.crc32(part.tobytes())))
        cols = list(zip(*rows, strict=True))
        block = pa.array((serial + np.arange(len(rows))) % blocks, pa.int32())
        serial += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), block], ["doc_id", "piece", "start", "length", "ids_crc32", "block"])


def _place(batches: Iterator[pa.RecordBatch], table: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0]))
        for c, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[c:e]
            rows = table[int(length[at[0]])]
            k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
            sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
            offset[at] = rows[k, 2]
        keep = b.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, kind: str = "word", end: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: the end id alone. Only documents of more than `capacity` ids are cut. Rows with a null doc_id
    are packed like any other; repeated rows are packed each. Other columns are ignored. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = functools.partial(_pieces, tokenizer=tokenizer, kind=kind, end=end, capacity=capacity, blocks=blocks)
    pieces = scratch.table(src.mapInArrow(cut, schema + ", block int"), "pieces")
    counts = scratch.table(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(base, ["length", "block"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(functools.partial(_place, table=table), schema + ", sequence_id long, offset long")
