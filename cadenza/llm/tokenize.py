"""Exact token ids of whole texts: numpy cuts a batch of texts into the tokenizer's words, and only words that the
worker has not met yet are given to the tokenizers library. Texts with a special token, or with characters that Python's
Unicode tables don't know yet, go to the library whole."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

from .common import distinct_spans, mix, powers, spans_equal

_U = np.uint64
OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
#: Words that a worker remembers at most; then it starts anew.
REMEMBERED = 1_500_000
_tables: dict[str, np.ndarray] = {}
_caches: dict[tuple[str, str], WordCache] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its class, and a random 64-bit value."""
    if not _tables:
        kinds, unknown = np.zeros(sys.maxunicode + 1, np.uint8), np.zeros(sys.maxunicode + 1, bool)
        for i in range(sys.maxunicode + 1):
            category = unicodedata.category(chr(i))
            c, unknown[i] = category[0], category == "Cn"
            kinds[i] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
        kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE  # the White_Space property
        _tables["kind"], _tables["unknown"] = kinds, unknown
        _tables["value"] = mix(np.arange(sys.maxunicode + 1, dtype=_U), 0x5EED) | _U(1)
    return _tables["kind"], _tables["value"]


def _contractions(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of 's 't 're 've 'm 'll 'd at each apostrophe `at` that opens a run of one and precedes a letter; 0: none."""
    one, two = cp[at + 1], cp[np.minimum(at + 2, len(cp) - 1)]
    s, t, m, d, r, v, l, e = (ord(x) for x in "stmdrvle")
    single = (one == s) | (one == t) | (one == m) | (one == d)
    pair = ((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == l) & (two == l))
    return np.where(single, 2, np.where(pair, 3, 0))


def split(texts: list[str], spaced: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, its code points, starts, ends, document, hashes) of the words. Hashes sort words, they don't name them.

    spaced: the byte-level pattern, where one blank goes with the word after it and white space forms words of its
    own; otherwise white space is dropped and every number character stands alone.
    """
    kinds, values = _classes()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kinds[cp]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    last = np.cumsum(lengths) - 1
    k[last] = END
    before = np.concatenate([[np.uint8(END)], k[:-1]])
    after = np.concatenate([k[1:], [np.uint8(END)]])
    blank = cp == 32
    after_blank = np.concatenate([[False], (blank & (k == SPACE))[:-1]])
    run = k != before
    word = k < SPACE
    if spaced:
        start = run & word & ~after_blank
        start |= (k == SPACE) & (run | ((after != SPACE) & (after != END)))
    else:
        start = word & (run | (k == NUMBER))
    q = np.flatnonzero((cp == 39) & run & (after == LETTER) & (k == OTHER) & (~after_blank if spaced else True))
    if len(q):
        n = _contractions(cp, q)
        q, n = q[n > 0], n[n > 0]
        start[q + 1] = False
        rest = q + n
        start[rest[k[rest] == LETTER]] = True
    starts = np.flatnonzero(start)
    stop = start | (k == END) if spaced else start | (k >= SPACE)
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    up, down = powers(len(cp) + 1)
    prefix = np.zeros(len(cp) + 1, _U)
    np.cumsum(values[cp] * up[:-1], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))
    return joined, cp, starts, ends, np.searchsorted(last, starts), hashes


def normalised(text: str) -> str:
    """NFC, then lower case character by character; white space only separates, so it may stay."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordCache:
    """Ids of the words met so far: sorted hashes beside the words themselves and places in one array of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.loaded = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words never hold a special token; `loaded` cuts texts that do
        self.special = [t.content for t in self.loaded.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = [i for w, i in vocabulary.items() if w.endswith("</w>")]
        #: By id: does it end a joined word; and is it part of that word (else it is the line break itself).
        self.closing, self.kept = np.zeros(max(vocabulary.values()) + 1, bool), int(bool(ends))
        self.closing[ends or self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.place, self.length, self.ids = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.at, self.size, self.spelled = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def tokenized(self, words: list[str]) -> list[list[int]]:
        """Ids by word. Words without white space but one blank before them are joined by line breaks, which the
        tokenizer never merges with them, and told apart by what ends a word; a count that differs sends them singly."""
        lists: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.lstrip(" ").isprintable() and " " not in w[1:] and w.strip()]
        for c in range(0, len(plain), 1000):
            part = plain[c : c + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words[i] for i in part) + "\n"], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.closing[ids])
            if len(stops) == len(part):
                for i, s, e in zip(part, [0, *(stops[:-1] + 1).tolist()], (stops + self.kept).tolist(), strict=True):
                    lists[i] = ids[s:e].tolist()
        left = [i for i, x in enumerate(lists) if x is None]
        for i, e in zip(left, self.tokenizer.encode_batch_fast([words[i] for i in left], add_special_tokens=False), strict=True):
            lists[i] = e.ids
        return lists

    def find(self, hashes: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word in the cache, -1 if it isn't there."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = np.flatnonzero((self.known[at] == hashes) & (self.size[at] == sizes))
        hit = hit[spans_equal(cp, starts[hit], self.spelled, self.at[at[hit]], sizes[hit])]
        out = np.full(len(hashes), -1)
        out[hit] = at[hit]
        return out

    def add(self, hashes: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Remembers words whose hashes are sorted, distinct and not known; their ids lie at `place` in ids."""
        at = np.searchsorted(self.known, hashes)
        new = {"known": hashes, "place": place + len(self.ids), "length": length, "at": len(self.spelled) + np.cumsum(sizes) - sizes, "size": sizes}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.spelled, self.ids = np.concatenate([self.spelled, gather(cp, starts, sizes)]), np.concatenate([self.ids, ids])


def among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is one of the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def gather(values: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[place : place + length] of each, one after another."""
    ends = np.cumsum(length)
    return values[np.repeat(place - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def largest_id(path: str, kind: str) -> int:
    """The largest id of the tokenizer's vocabulary."""
    cache = _caches.get((path, kind)) or _caches.setdefault((path, kind), WordCache(path))
    return len(cache.closing) - 1


def odd(text: str, kind: str, special: list[str]) -> bool:
    """Whether a text goes to the library whole."""
    if any(s[:2] in text for s in special) and any(s in text or s in text.lower() for s in special):
        return True
    if kind != "word" or text.isascii():
        return False
    _classes()
    return bool(_tables["unknown"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def encode(texts: list[str], path: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number of ids by text), as the library gives them without adding special
    tokens. kind: "byte" or "word", the file's pre-tokenizer."""
    cache = _caches.get((path, kind)) or _caches.setdefault((path, kind), WordCache(path))
    apart = [i for i, t in enumerate(texts) if odd(t, kind, cache.special)]
    apart_set = set(apart)
    ids, counts = _encode_words(texts if not apart else ["" if i in apart_set else t for i, t in enumerate(texts)], cache, kind)
    if not apart:
        return ids, counts
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for i, e in zip(apart, cache.loaded.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False), strict=True):
        parts[i], counts[i] = np.array(e.ids, ids.dtype), len(e.ids)
    return np.concatenate(parts), counts


def _encode_words(texts: list[str], cache: WordCache, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind == "word":
        texts = [normalised(t) for t in texts]
    joined, cp, starts, ends, doc, hashes = split(texts, kind == "byte")
    first, which = distinct_spans(cp, starts, ends, hashes)
    start, size, h = starts[first], ends[first] - starts[first], hashes[first]
    number = cache.find(h, cp, start, size)
    if len(cache.known) + np.count_nonzero(number < 0) > REMEMBERED:
        cache.clear()
        number[:] = -1
    missing = np.flatnonzero(number < 0)
    lists = cache.tokenized([joined[s : s + n] for s, n in zip(start[missing].tolist(), size[missing].tolist(), strict=True)]) if len(missing) else []
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    new = np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum()))
    place, length = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    old = np.flatnonzero(number >= 0)
    place[old], length[old] = cache.place[number[old]], cache.length[number[old]]
    place[missing], length[missing] = len(cache.ids) + np.cumsum(n) - n, n
    pool = np.concatenate([cache.ids, new]) if len(new) else cache.ids
    ids, counts = gather(pool, place[which], length[which]), np.zeros(len(texts), np.int64)
    np.add.at(counts, doc, length[which])
    # remembered: one word for each new hash; another word with the hash of a known one is encoded anew each time
    by = missing[np.argsort(h[missing], kind="stable")]
    fresh = by[np.concatenate([[True], h[by][1:] != h[by][:-1]]) & ~among(cache.known, h[by])] if len(by) else by
    cache.add(h[fresh], cp, start[fresh], size[fresh], place[fresh] - len(cache.ids), length[fresh], new)
    return ids, counts
