"""GIF: a decoder for timed frames (LZW code streams, palettes, interlacing, transparency, disposal) with colour
histograms, and an encoder that stores any payload losslessly as 8-bit samples."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Samples in a row, rows in a frame and hundredths of a second that a frame stays, of what the encoder writes.
WIDTH, FRAME_ROWS, DELAY = 192, 256, 10
BINS = 8
#: Pixels of a canvas, and of a region, that `frames` decodes at most; larger ones give an error row.
MOST_PIXELS = 1 << 24
#: Bytes of samples after which `timed` passes its rows on.
HELD_BYTES = 1 << 20
_FULL = 4096


# --------------------------------------------------------------------------- LZW


@functools.cache
def _early_widths(bits: int) -> np.ndarray:
    known = (1 << bits) + 2 + np.maximum(np.arange(_FULL + 2) - 1, 0)
    return np.clip(np.ceil(np.log2(known + 1)).astype(np.int64), bits + 1, 12)


def code_widths(first: int, n: int, bits: int) -> np.ndarray:
    """Bits of the codes first .. first + n - 1 after a clear code, for symbols of `bits` bits."""
    early = _early_widths(bits)[first : first + n]
    return early if len(early) == n else np.concatenate([early, np.full(n - len(early), 12)])


_WIDTHS = code_widths(0, _FULL + 2, 8)


def lzw_codes(data: bytes) -> tuple[list[int], list[int]]:
    """(codes, their widths) of 8-bit symbols, clear codes and end included."""
    codes: list[int] = [256]
    segments: list[int] = []
    table: dict[int, int] = {}
    new, last = 258, 0
    it = iter(data)
    current = next(it, None)
    if current is not None:
        get, add = table.get, codes.append
        for c in it:
            k = current << 8 | c
            found = get(k)
            if found is not None:
                current = found
                continue
            add(current)
            table[k] = new
            new += 1
            current = c
            if new == _FULL:
                add(256)
                segments.append(len(codes) - 1 - last)
                last = len(codes) - 1
                table.clear()
                new = 258
        add(current)
    add_end = codes.append
    add_end(257)
    segments.append(len(codes) - 1 - last)
    widths = np.concatenate([[9], *(_WIDTHS[:n] for n in segments)])
    return codes, widths


def pack_codes(codes: list[int], widths: np.ndarray) -> bytes:
    """Least significant bit first."""
    value, ends = np.array(codes, np.int64), np.cumsum(widths)
    at = ends - widths
    value <<= at & 7
    byte = at >> 3
    out = np.zeros(int(ends[-1] + 7) // 8 + 3)
    for j in range(3):
        out += np.bincount(byte + j, (value >> (8 * j)) & 255, len(out))
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """At most `size` symbols; a stream that ends early gives fewer, a code out of turn raises ValueError."""
    clear = 1 << bits
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(data) * 8
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    have, at, first = 0, 0, 0
    table, previous = base.copy(), b""
    while at + bits + 1 <= total and have < size:
        widths = code_widths(first, min(_FULL, (total - at) // (bits + 1) + 1), bits)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, "right"))
        if not n:
            break
        starts = ends[:n] - widths[:n]
        byte = starts >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7)) & ((1 << widths[:n]) - 1)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(special[0]) if len(special) else n
        for c in codes[:stop].tolist():
            if c < len(table):
                entry = table[c]
            elif c == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise ValueError(f"LZW code {c} before it is defined")
            out.append(entry)
            if previous and len(table) < _FULL:
                table.append(previous + entry[:1])
            previous = entry
        have += sum(map(len, out[len(out) - stop :]))
        if stop == n:
            first, at = first + n, int(ends[n - 1])
            continue
        if codes[stop] == clear + 1:
            break
        table, previous, first, at = base.copy(), b"", 0, int(ends[stop])
    return b"".join(out)[:size]


# --------------------------------------------------------------------------- files


def encode_gif(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes. Grey values are the samples; frames of FRAME_ROWS rows follow one another."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError(f"the payload isn't a positive multiple of {WIDTH} bytes")
    out = [b"GIF89a" + struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    for r in range(0, rows, FRAME_ROWS):
        part = payload[r * WIDTH : (r + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        stream = pack_codes(*lzw_codes(part))
        out += [bytes([len(x)]) + x for x in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """start and delay in milliseconds; the region that the frame drew, and the whole canvas after it (RGBA)."""

    start: int
    delay: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray

    def histogram(self) -> np.ndarray:
        """Counts of visible pixels by the upper bits of red, green and blue: 3 x BINS."""
        seen = self.canvas.reshape(-1, 4)
        if not seen[:, 3].all():
            seen = seen[seen[:, 3] > 0]
        return np.stack([np.bincount(seen[:, c] // (256 // BINS), minlength=BINS) for c in range(3)])

    def samples(self) -> bytes:
        """The drawn region of a grey picture, as 8-bit samples."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width, 0].tobytes()


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _rows_in_order(height: int) -> np.ndarray:
    """Where the rows of an interlaced frame belong."""
    return np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, most_pixels: int | None = None) -> Iterator[Frame]:
    """The frames as a viewer shows them. Raises ValueError or IndexError on damaged data, and ValueError where a canvas
    or a region has more than `most_pixels`, before either is allocated."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if most_pixels is not None and width * height > most_pixels:
        raise ValueError(f"a canvas of {width} x {height} has more than {most_pixels} pixels")
    at, palette = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    clock, delay, disposal, clear = 0, 0, 0, None
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                f, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = (f >> 2) & 7, index if f & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        if most_pixels is not None and w * h > most_pixels:
            raise ValueError(f"a region of {w} x {h} has more than {most_pixels} pixels")
        colours = palette
        if f & 0x80:
            n = 2 << (f & 7)
            colours, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        symbols = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        if len(symbols) < w * h:
            raise ValueError("the code stream ends early")
        picture = symbols.reshape(h, w)
        if f & 0x40:
            straight = np.empty_like(picture)
            straight[_rows_in_order(h)] = picture
            picture = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        inside = picture[: area.shape[0], : area.shape[1]]
        if clear is None:
            area[..., :3], area[..., 3] = colours[inside], 255
        else:
            drawn = inside != clear
            area[drawn] = np.concatenate([colours[inside[drawn]], np.full((int(drawn.sum()), 1), 255, np.uint8)], 1)
        yield Frame(clock, delay * 10, left, top, w, h, canvas.copy())
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        clock, delay, disposal, clear = clock + delay * 10, 0, 0, None


# --------------------------------------------------------------------------- tables


def pad(raw: bytes) -> bytes:
    """Blanks up to a positive multiple of WIDTH."""
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        for i in range(0, len(texts), 200):
            part = texts[i : i + 200]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array([encode_gif(pad(t)) for t in part], pa.binary())], ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the whole text as a GIF."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _frames(batches: Iterator[pa.RecordBatch], most_pixels: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "red", "green", "blue", "pixels", "error"]
    counts = pa.list_(pa.int64())
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), counts, counts, counts, pa.binary(), pa.string()]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for doc, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                for k, f in enumerate(decode_gif(media or b"", most_pixels)):
                    h, w = f.canvas.shape[:2]
                    yield out([(doc, k, f.start, f.delay, w, h, *f.histogram().tolist(), f.canvas.tobytes(), None)])
            except (ValueError, IndexError, struct.error) as e:
                yield out([(doc, None, None, None, None, None, None, None, None, None, str(e))])


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per frame: doc_id, frame, start_ms, delay_ms, width, height, red, green, blue (histograms of BINS bins),
    pixels (RGBA of the whole canvas) and error. Media that can't be decoded, null included, give the frames before the
    damage and a row with the error alone; so do those with a canvas or region above `most_pixels`, which bounds a
    task's memory."""
    schema = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, red array<long>, green array<long>, blue array<long>, pixels binary, error string"
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(functools.partial(_frames, most_pixels=most_pixels), schema)


def _timed(batches: Iterator[pa.RecordBatch], at: int, most_pixels: int) -> Iterator[pa.RecordBatch]:
    times, counts = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
    types = [times, times, counts, counts, counts, pa.list_(pa.binary()), pa.string()]
    for b in batches:
        others = [i for i in range(b.num_columns) if i != at]
        names = [*(b.schema.names[i] for i in others), "start_ms", "delay_ms", "red", "green", "blue", "samples", "error"]
        rows: list[list] = []
        size = 0
        for k, media in enumerate(b.column(at)):
            shown, error = [], None
            try:
                for f in decode_gif(media.as_py() or b"", most_pixels):
                    shown.append((f.start, f.delay, *f.histogram().tolist(), f.samples()))
                    size += len(shown[-1][-1])
            except (ValueError, IndexError, struct.error) as e:
                error = str(e)
            rows.append([*(list(c) for c in zip(*shown, strict=True)), error] if shown else [[]] * 6 + [error])
            if size > HELD_BYTES or k + 1 == b.num_rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(k + 1 - len(rows), len(rows)) for i in others), *arrays], names)
                rows, size = [], 0


def timed(media: DataFrame, media_col: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per medium: its other columns, then as arrays with a value for each frame start_ms, delay_ms, red, green,
    blue (histograms of BINS bins of the canvas shown) and samples (the drawn region of a grey picture), and error.

    Media that can't be decoded, null included, have the frames before the damage and an error, as in `frames`, whose
    rows hold whole canvases in colour instead."""
    own = "start_ms array<long>, delay_ms array<long>, red array<array<long>>, green array<array<long>>, blue array<array<long>>, samples array<binary>, error string"
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != media_col)
    return media.mapInArrow(functools.partial(_timed, at=media.columns.index(media_col), most_pixels=most_pixels), f"{others}, {own}" if others else own)


def feature(delays: list[int], histograms: np.ndarray) -> str:
    """Frames, milliseconds, and the pixels shown by colour and bin, over all frames (3 x BINS)."""
    colours = ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip(("red", "green", "blue"), histograms.tolist(), strict=True))
    return f"frames={len(delays)};ms={sum(delays)};{colours}"


def payload(data: bytes) -> tuple[bytes, str]:
    """(samples of the drawn regions one after another, feature) of one medium."""
    parts, delays, counts = [], [], np.zeros((3, BINS), np.int64)
    for f in decode_gif(data):
        parts.append(f.samples())
        delays.append(f.delay)
        counts += f.histogram()
    return b"".join(parts), feature(delays, counts)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for b in batches:
        rows = []
        for k in range(b.num_rows):  # a document's frames at a time
            doc, n, media_bytes, media_sha256, delays, samples, *colours = (b.column(c)[k].as_py() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "delay_ms", "samples", "red", "green", "blue"))
            raw = b"".join(samples)
            rows.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), media_bytes, media_sha256, feature(delays, np.array(colours, np.int64).sum(1))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a GIF in a table of the shared folder, reads it back, stores its timed frames with their
    colour histograms in another, and returns digests of these: a row per document.

    Null or empty text: a row of blanks. Null ids and repeated rows each get a row. Other columns are ignored. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "gif")
    media = scratch.table(encode(docs, id_col, text_col), "media")
    shown = scratch.table(timed(media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")), "frames")
    scratch.drop(media)
    return shown.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
