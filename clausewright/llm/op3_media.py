"""Media columns: AVI motion-JPEG files in a binary column become timed clip rows.

The RIFF structure gives the frame rate and the place of each frame: from the ``idx1`` index for the first RIFF
segment; for the others, or without it, from OpenDML ``ix##`` indexes, else by walking the ``movi`` list. Each intra frame is decoded; its histogram (32 soft bins of luma, 8 of each chroma) is compared with
that of the frame before it. A shot ends where the difference (half the L1 distance) is ``FLOOR`` or more, the largest within
``RADIUS`` frames, and more than ``RATIO`` times the mean of the other differences within ``RADIUS`` frames.

Defined results
* null, empty or malformed content, or a file without a motion-JPEG stream or frames: one row with shot null and the reason in
  ``error``; null ``media_id``: read like any other; repeated rows: each gives its clips;
* a frame that can't be decoded (or is empty: a repeat of the one before) takes its time but no part in the differences, and is
  counted in ``bad_frames`` if it isn't empty; a file with no decodable frame is one shot;
* equal differences: the earliest frame is the cut; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import jpeg
from clausewright.session import require

FLOOR, RATIO, RADIUS = 0.2, 3.0, 4
#: Frames that are decoded together.
BATCH = 64
SCHEMA = T.StructType(
    [T.StructField("media_id", T.LongType()), T.StructField("shot", T.IntegerType()), T.StructField("first_frame", T.IntegerType()), T.StructField("frames", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("cut_difference", T.DoubleType()), T.StructField("bad_frames", T.IntegerType()), T.StructField("error", T.StringType())]
)
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]


class BadFile(ValueError):
    """The bytes are no AVI file with a motion-JPEG stream."""


def _u32(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise BadFile("the file ends too early")
    return int.from_bytes(data[at : at + 4], "little")


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(four letters, start, end) of the bodies of the chunks in data[at:end]; the last may be cut short by the end of the file."""
    while at + 8 <= end:
        size = _u32(data, at + 4)
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def index(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """(frames a second, (start, end) of each frame) of the first motion-JPEG stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadFile("no RIFF AVI header")
    rate, stream, streams = 0.0, -1, 0
    movies: list[tuple[int, int]] = []
    old: tuple[int, int] | None = None
    for name, s, e in chunks(data, 0, len(data)):
        if name != b"RIFF":
            continue
        for inner, a, b in chunks(data, s + 4, e):
            if inner == b"LIST" and data[a : a + 4] == b"movi":
                movies.append((a + 4, b))
            elif inner == b"idx1":
                old = (a, b)
            elif inner == b"LIST" and data[a : a + 4] == b"hdrl":
                for part, p, q in chunks(data, a + 4, b):
                    if part == b"LIST" and data[p : p + 4] == b"strl":
                        for x, y, z in chunks(data, p + 4, q):
                            if x == b"strh" and stream < 0 and data[y : y + 4] == b"vids" and data[y + 4 : y + 8].upper() in (b"MJPG", b"\0\0\0\0", b"JPEG", b"AVRN"):
                                scale = _u32(data, y + 20)
                                rate, stream = _u32(data, y + 24) / scale if scale else 0.0, streams
                        streams += 1
    if stream < 0 or not rate:
        raise BadFile("no motion-JPEG stream")
    if not movies:
        raise BadFile("no movi list")
    ids = {b"%02d%s" % (stream, kind) for kind in (b"dc", b"db")}
    frames: list[tuple[int, int]] = []
    if old:
        base = movies[0][0] - 4
        entries = [(data[i : i + 4], _u32(data, i + 8), _u32(data, i + 12)) for i in range(old[0], old[1] - 15, 16)]
        mine = [(o, n) for name, o, n in entries if name in ids]
        if mine:  # offsets count from the movi list, or in some files from the start
            o = mine[0][0]
            if data[base + o : base + o + 4] not in ids and data[o : o + 4] in ids:
                base = 0
            frames = [(base + o + 8, base + o + 8 + n) for o, n in mine]
    # idx1 covers the first RIFF segment only; each other movi list has ix## indexes of its own, or is walked
    for s, e in movies[bool(frames) :]:
        found: list[tuple[int, int]] = []
        for name, a, b in chunks(data, s, e):
            if name == b"ix%02d" % stream and b - a >= 24:
                base = int.from_bytes(data[a + 12 : a + 20], "little")
                found += [(base + _u32(data, i), base + _u32(data, i) + (_u32(data, i + 4) & 0x7FFFFFFF)) for i in range(a + 24, min(b - 7, a + 24 + 8 * _u32(data, a + 4)), 8)]
        todo = [] if found else [(s, e)]
        while todo:
            s, e = todo.pop(0)
            inner = []
            for name, a, b in chunks(data, s, e):
                if name in ids:
                    found.append((a, b))
                elif name == b"LIST":
                    inner.append((a + 4, b))
            todo = inner + todo
        frames += found
    if not frames:
        raise BadFile("no frames")
    return rate, frames


def _soft_bins(bins: int) -> np.ndarray:
    """(256, bins + 1): a value counts for the two nearest bin edges, so that slow drift moves little from bin to bin."""
    at, step = np.arange(256), 256 // bins
    m = np.zeros((256, bins + 1))
    m[at, at // step] = 1 - at % step / step
    m[at, at // step + 1] += at % step / step
    return m


_LUMA, _CHROMA = _soft_bins(32), _soft_bins(8)


def histogram(planes: list[np.ndarray]) -> np.ndarray:
    parts = [np.bincount(p.ravel(), minlength=256) @ (_CHROMA if k else _LUMA) / p.size for k, p in enumerate(planes)]
    return np.concatenate([x / len(parts) for x in parts])


def cuts(differences: np.ndarray) -> np.ndarray:
    """The frames that begin a shot; differences[t] belongs to frames t - 1 and t, differences[0] is 0."""
    out = []
    for t in np.flatnonzero(differences >= FLOOR):
        low, high = max(1, t - RADIUS), min(len(differences), t + RADIUS + 1)
        around = np.concatenate((differences[low:t], differences[t + 1 : high]))
        if t and differences[t] > around.mean() * RATIO if len(around) else t:
            if (differences[low:t] < differences[t]).all() and (differences[t + 1 : high] <= differences[t]).all():
                out.append(t)
    return np.array(out, int)


def clips(content: bytes | None) -> list[tuple]:
    """Rows of SCHEMA without the id."""
    try:
        rate, frames = index(content or b"")
    except BadFile as e:
        return [(None, None, None, None, None, None, None, str(e))]
    differences, bad = np.zeros(len(frames)), np.zeros(len(frames), int)
    before = None
    for first in range(0, len(frames), BATCH):
        part = [(t, s, e) for t, (s, e) in enumerate(frames[first : first + BATCH], first) if s < e]
        for (t, _, _), planes in zip(part, jpeg.decode_all([content[s:e] for _, s, e in part]), strict=True):
            if isinstance(planes, jpeg.BadFrame):
                bad[t] = 1
                continue
            now = histogram(planes)
            if before is not None:
                differences[t] = np.abs(now - before).sum() / 2 if len(now) == len(before) else 1.0
            before = now
    begins = [0, *cuts(differences).tolist()]
    return [(k, a, b - a, round(a / rate, 6), round(b / rate, 6), round(float(differences[a]), 6), int(bad[a:b].sum()), None) for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(frames)], strict=True))]


def detect(media: DataFrame) -> DataFrame:
    """Clip rows of a table with ``media_id`` and ``content``. Narrow: files stay where they are read, one at a time is in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *row) for i, content in zip(*batch.columns, strict=True) for row in clips(content.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], SCHEMA.names)

    return require(media, {"media_id": T.LongType(), "content": T.BinaryType()}).mapInArrow(run, SCHEMA)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = 8, with_index: bool = True) -> bytes:
    """A motion-JPEG AVI file."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)

    def words(*values: int) -> bytes:
        return b"".join(v.to_bytes(4, "little") for v in values)

    avih = words(1_000_000 // rate, 0, 0, 0x10 if with_index else 0, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + words(0, 0, 0, 1, rate, 0, len(frames), 0, 0, 0) + bytes(8)
    strf = words(40, width, height, 1 | 24 << 16) + b"MJPG" + words(width * height * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    movi, places = b"movi", b""
    for f in frames:
        places += b"00dc" + words(0x10, len(movi), len(f))
        movi += chunk(b"00dc", f)
    body = b"AVI " + hdrl + chunk(b"LIST", movi)
    if with_index:
        body += chunk(b"idx1", places)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def render(vector: list[float] | None, scenes: int = 3, frames: int = 6) -> bytes | None:
    """A colour film made of a vector. Its numbers are cut into one run for each scene; the numbers of a run are the tones of the scene's
    blocks, one after the other those of luma, Cb and Cr (4:2:0, as many units as hold them all; a run begins anew
    where blocks are left over). Luma drifts slowly from frame to frame. Each row of units ends in a restart marker."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float))
    v = np.clip((v - v.min()) / (np.ptp(v) or 1.0), 0, 1) * 200 + 20
    runs = [v[s * len(v) // scenes : (s + 1) * len(v) // scenes] for s in range(scenes)]
    k = math.isqrt(max(0, -(-max(map(len, runs)) // 6) - 1)) + 1  # units to a side
    out = []
    for s, run in enumerate(runs):
        tones = np.resize(run if len(run) else v, 6 * k * k)
        luma, cb, cr = (np.kron(t.reshape(side, side), np.ones((8, 8))) for t, side in zip(np.split(tones, [4 * k * k, 5 * k * k]), (2 * k, k, k), strict=True))
        for t in range(frames - s):
            planes = [np.clip(p, 0, 255).astype(np.uint8) for p in (luma + 0.5 * t, cb, cr)]
            out.append(jpeg.encode(planes, (2, 2), restart=k))
    return write_avi(out, 16 * k, 16 * k)


def rendered(embeddings: DataFrame) -> DataFrame:
    """(media_id, content) films of the rows (vec_id, embedding): the test tables hold no media of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            films = [render(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(films, pa.binary())], ["media_id", "content"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "media_id long, content binary")
