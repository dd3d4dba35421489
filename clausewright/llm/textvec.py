"""Whole texts to arrays of word and character hashes, many documents at a time.

Every function takes plain Python strings (``None`` counts as an empty text) and works on one flat array of code points, so
the cost per character is a few vector operations. Texts are walked in windows of ``WINDOW`` code points that end between
words; a longer text is walked window by window, so that nothing is cut off and memory stays bounded by 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 17
#: Bytes of the batches that texts are worked on in; Arrow's own batches go by rows and may be far larger.
SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        points = [chr(i) for i in range(0x30000)]
        _tables["word"] = np.fromiter((c.isalnum() for c in points), bool, len(points))
        lower = (c.lower() for c in points)
        _tables["lower"] = np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(lower)), np.uint32, len(points))
    return _tables[name]


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, WINDOW + 1024), base, np.uint64)
        have[0] = 1
        _tables[name] = have = np.multiply.accumulate(have)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_word(cp: np.ndarray) -> np.ndarray:
    table = _table("word")
    return table[np.minimum(cp, len(table) - 1)]


def lowered(cp: np.ndarray) -> np.ndarray:
    table = _table("lower")
    return np.where(cp < len(table), table[np.minimum(cp, len(table) - 1)], cp)


def sliced(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, one row at least, so that few texts are Python strings at a time."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(texts: list[str | None], limit: int = WINDOW) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts of at most ``limit`` characters together; a longer text is a run of its own."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield first, run


def _window_words(cp: np.ndarray, case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], is_word(cp), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    values = (cp if case else lowered(cp)).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(values * _powers("power", _ODD, len(cp) + 1)[: len(cp)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers("inverse", _INVERSE, len(cp) + 1)[starts]
    return mix(hashes), starts, ends


def words(texts: list[str], case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every maximal letter-or-digit run, in order. start and end are code points in its text."""
    joined = "\n".join(texts) + "\n"
    cp = code_points(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    parts, at = [], 0
    while at < len(cp):
        stop = min(len(cp), at + WINDOW)
        while stop < len(cp):  # a window ends between words
            gap = np.flatnonzero(~is_word(cp[stop : stop + 4096]))
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(len(cp), stop + 4096)
        h, s, e = _window_words(cp[at:stop], case)
        parts.append((h, s + at, e + at))
        at = stop
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = np.searchsorted(begins, starts, "right") - 1
    return hashes, owner, starts - begins[owner], ends - begins[owner]


def word_ngrams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring words of one text, and the text number of each."""
    if n == 1 or len(hashes) < n:
        return (hashes, owner) if n == 1 else (hashes[:0], owner[:0])
    h = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    same = owner[: len(owner) - n + 1] == owner[n - 1 :]
    return mix(h[same]), owner[: len(owner) - n + 1][same]


def char_ngrams(texts: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window by window: 32-bit hashes of n neighbouring characters of one text, and the text number of each."""
    joined = "\n".join(texts) + "\n"
    cp = code_points(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    for at in range(0, len(cp), WINDOW):
        part = cp[at : min(len(cp), at + WINDOW + n - 1)]
        m = len(part) - n + 1
        if m <= 0:
            continue
        h = part[:m] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ part[k : m + k]) * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        position = np.arange(at, at + m)
        owner = np.searchsorted(begins, position, "right") - 1
        keep = position + n <= begins[owner] + lengths[owner]
        yield h[keep], owner[keep]


def simhash(texts: list[str | None], orders: tuple[int, ...], bits: int = 64) -> np.ndarray:
    """(len(texts), bits // 64) unsigned fingerprints: the majority of the bits of the distinct word n-grams of each text, for n
    in ``orders``. A text without words gets 0; a text with words that would get 0 gets 1."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    for first, run in groups(texts):
        hashes, owner, _, _ = words(run)
        h, o = (np.concatenate(x) for x in zip(*[word_ngrams(hashes, owner, n) for n in orders], strict=True))
        if not len(h):
            continue
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        h, o = h[fresh], o[fresh]
        for word in range(bits // 64):
            value = h if word == 0 else mix(h + np.uint64(word * 0x632BE59BD9B4E019))
            sums = np.zeros((len(run), 64), np.int64)
            for at in range(0, len(h), 1 << 16):
                v, who = value[at : at + (1 << 16)], o[at : at + (1 << 16)]
                spread = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
                begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                sums[who[begin]] += np.add.reduceat(spread, begin, axis=0, dtype=np.int32)
            total = np.bincount(o, minlength=len(run))
            packed = np.packbits(2 * sums > total[:, None], axis=1, bitorder="little")
            out[first : first + len(run), word] = packed.view(np.uint64)[:, 0]
        wordy = np.bincount(o, minlength=len(run)) > 0
        empty = (out[first : first + len(run)] == 0).all(axis=1)
        out[first : first + len(run), 0] += (wordy & empty).astype(np.uint64)
    return out
