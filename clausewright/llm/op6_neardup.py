"""SimHash near-duplicates by pivot distance tables.

Each text gets a 128-bit SimHash of its distinct words and word pairs. Rows of equal fingerprint are one node (an exact way for
any number of copies). The bits are cut into ``CHUNKS`` chunks of three parts. Two fingerprints within ``RADIUS`` = 3 * CHUNKS - 1
bits differ in at most ``SPARE`` = 2 bits of some chunk, and so agree in one of its three parts: nodes meet in one table for each
of the 21 parts, keyed by its bits, and no pair within the radius is lost. In a bucket only rows are compared whose other bits of
the chunk differ in at most ``SPARE`` places, first by the half of the fingerprint that holds less of the chunk. Of what is left,
a pair is discarded as soon as one of its distances to ``PIVOTS`` reference fingerprints differs by more than ``RADIUS`` (by the
triangle inequality it can't be within ``RADIUS``), and survivors are verified bit by bit. Connected nodes are one group, and the
smallest ``doc_id`` of a group stays.

No bucket, candidate or partner is capped: a bucket is walked in blocks of bounded memory. Parts only say which pairs get
compared: the pivot tables alone would compare all pairs, as their coordinates concentrate around 64 (see README).

Defined results
* null text counts as empty; texts without any word are never duplicates of anything: each is a group of its own;
* null ``doc_id``: the row is kept out of the search and reported with null group, ``keep`` true;
* rows that repeat a ``doc_id`` are one group: each row is reported, ``keep`` tells whether the id stays; ``drop_copies`` keeps
  the one of the least text hash;
* ties: the smallest ``doc_id`` of a group stays; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import textvec
from clausewright.session import cut, require

#: Near copies of Jaccard 0.85 lie at about 16 bits, unrelated texts beyond 27.
RADIUS, PIVOTS = 20, 48
#: Parts of a chunk agree in one at least where no more than SPARE bits of it differ; CHUNKS * (SPARE + 1) must exceed RADIUS.
CHUNKS, SPARE = 7, 2
BLOCK = 1 << 20
#: Pairs compared by one call, and counts of bits gathered before they are looked at: what the caches hold.
PIECE, COUNTS = 1 << 14, 1 << 19
#: Rows of a bucket that are compared each with each at once, rows of a pivot table made at a time, rows of groups' neighbours listed at a time.
FEW, SOME, LISTED = 32, 1 << 10, 1 << 20
#: Edges that are gathered before they are handed on.
EDGES = 1 << 16
#: Dropped ids are broadcast to the texts up to this number (8 MB of longs); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
FINGERPRINT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "f0", "f1")])
LINK = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("distance", T.IntegerType())])


def _cuts(start: int, stop: int, n: int) -> list[tuple[int, int]]:
    at = [start + (stop - start) * k // n for k in range(n + 1)]
    return list(zip(at, at[1:], strict=False))


#: Bits from, bits to, of each chunk and of each part (in the order of their chunks).
CHUNK_BITS = _cuts(0, 128, CHUNKS)
PART_BITS = [p for c in CHUNK_BITS for p in _cuts(*c, SPARE + 1)]
#: The bits of a bucket's key that hold the value of its part.
VALUE_BITS = max(b - a for a, b in PART_BITS)


def _masks(spans: list[tuple[int, int]]) -> np.ndarray:
    bits = np.zeros((len(spans), 128), np.uint8)
    for row, (a, b) in zip(bits, spans, strict=True):
        row[a:b] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of a Hadamard matrix and random ones, so that the coordinates are nearly independent."""
    i = np.arange(128)
    rows = [(np.bitwise_count(np.uint64(r) & i.astype(np.uint64)) & 1).astype(np.uint8) for r in range(1, 1 + n // 2)]
    rows += list(np.random.default_rng(77).integers(0, 2, (n - len(rows), 128), np.uint8))
    return np.packbits(np.array(rows), axis=1, bitorder="little").view(np.uint64)


MASKS, CHUNK_MASKS = _masks(PART_BITS), _masks(CHUNK_BITS)
REFERENCE = pivots()


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(a ^ b)
    return ones[..., 0].astype(np.int16) + ones[..., 1]


def pivot_table(fp: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """(rows, pivots) Hamming distances."""
    out = np.empty((len(fp), len(reference)), np.uint8)
    for at in range(0, len(fp), SOME):
        some = fp[at : at + SOME, None]
        np.add(np.bitwise_count(some[..., 0] ^ reference[:, 0]), np.bitwise_count(some[..., 1] ^ reference[:, 1]), out=out[at : at + SOME])
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f0, f1 of every row; both null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.sliced(batches):
            fp = textvec.simhash(batch.column(1).to_pylist(), (1, 2), 128)
            none = (fp == 0).all(axis=1)
            f = [pa.array(fp[:, k].view(np.int64), pa.int64(), mask=none) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *f], ["doc_id", "f0", "f1"])

    return require(docs, {"doc_id": T.LongType(), "text": T.StringType()}).mapInArrow(run, FINGERPRINT)


def _within(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs within the radius: pivot distances first, eight by eight, then all bits."""
    table = np.ascontiguousarray(table[:, : table.shape[1] // 8 * 8], np.uint8).view(np.uint64)
    for k in range(table.shape[1]):
        eight = np.ascontiguousarray(table[:, k])
        a, b = eight[i].view(np.uint8), eight[j].view(np.uint8)
        near = (np.maximum(a, b) - np.minimum(a, b) > radius).view(np.uint64) == 0
        i, j = i[near], j[near]
    d = hamming(fp[i], fp[j])
    within = d <= radius
    return i[within], j[within], d[within]


def bucket_pairs(fp: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all pairs of one bucket within the radius. ``table``: its pivot distances."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    reach = np.searchsorted(first, first + radius, "right")  # partners of row k are order[k + 1 : reach[k]]
    count = reach - np.arange(len(order)) - 1
    at = 0
    while at < len(order):
        stop = at + max(1, int(np.searchsorted(np.cumsum(count[at:]), BLOCK, "right")))
        n = count[at:stop]
        left = np.repeat(np.arange(at, min(stop, len(order))), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + left + 1
        i, j, d = _within(fp, table, order[left], order[right], radius)
        if len(i):
            yield i, j, d
        at = stop


def _bits(fp: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The bits from ``start`` to ``stop`` of each fingerprint, as a number."""
    low, high = fp[:, start // 64] >> np.uint64(start % 64), fp[:, (stop - 1) // 64]
    if start // 64 != (stop - 1) // 64:
        low = low | high << np.uint64(64 - start)
    return (low & np.uint64((1 << (stop - start)) - 1)).astype(np.int64)


def _few_bits(width: int) -> np.ndarray:
    """The numbers of ``width`` bits that have at most ``SPARE`` bits set."""
    x = np.arange(1 << width)
    return x[np.bitwise_count(x) <= SPARE]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] numbers), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _hits(counts: np.ndarray, pieces: list[tuple[int, int, int, int]], size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the list) of the counts within the radius. A piece: its first count, its first row, where its list begins, its length."""
    at, row, begin, width = np.array(pieces).T
    padded = (size + 7) // 8 * 8
    counts[size:padded] = 255
    near = (counts[:padded] <= radius).reshape(-1, 8)
    eights = np.flatnonzero(near.view(np.uint64))
    k, one = np.nonzero(near[eights])
    hit = eights[k] * 8 + one
    p = np.searchsorted(at, hit, "right") - 1
    down, across = np.divmod(hit - at[p], width[p])
    return row[p] + down, begin[p] + across


def _candidates(half: np.ndarray, starts: np.ndarray, around: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows sorted by group, i < j among them, whose groups' numbers differ by one of ``around`` and whose halves are within the radius.
    Group g is rows starts[g] to starts[g + 1]; it meets the list of its neighbours' rows, thousands of pairs by one call."""
    sizes = np.diff(starts)
    groups = np.flatnonzero(sizes)
    step = max(1, LISTED // max(1, len(half) * len(around) // len(groups)))
    for k in range(0, len(groups), step):
        g = groups[k : k + step]
        other = g[:, None] ^ around[None, :]
        n = np.where(other >= g[:, None], sizes[other], 0)
        rows, ends = _ranges(starts[other.ravel()], n.ravel()), np.cumsum(n.sum(axis=1)).tolist()
        values, longest = half[rows], max(PIECE, int(n.sum(axis=1).max()))
        differ, counts = np.empty(longest, np.uint64), np.empty(max(COUNTS, longest) + 8, np.uint8)
        pieces, at, begin = [], 0, 0
        for first, last, end in zip(starts[g].tolist(), starts[g + 1].tolist(), ends, strict=True):
            width, high = end - begin, max(1, PIECE // (end - begin))
            for row in range(first, last, high):
                left = half[row : min(last, row + high), None]
                size = len(left) * width
                if at + size > len(counts) - 8:
                    i, j = _hits(counts, pieces, at, radius)
                    yield i, rows[j]
                    pieces, at = [], 0
                x = np.bitwise_xor(left, values[begin:end], out=differ[:size].reshape(-1, width))
                np.bitwise_count(x, out=counts[at : at + size].reshape(-1, width))
                pieces.append((at, row, begin, width))
                at += size
            begin = end
        i, j = _hits(counts, pieces, at, radius)
        yield i, rows[j]


def part_pairs(fp: np.ndarray, part: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of pairs of one bucket of ``part``: all within the radius whose chunk differs by at most ``SPARE`` bits, and
    maybe others within the radius. Rows are grouped by as many of the chunk's other bits as there are rows for."""
    if len(fp) <= FEW:
        yield from bucket_pairs(fp, pivot_table(fp, REFERENCE), radius)
        return
    chunk = part // (SPARE + 1)
    other, width = np.zeros(len(fp), np.int64), 0
    for p in range(chunk * (SPARE + 1), (chunk + 1) * (SPARE + 1)):
        if p != part:
            a, b = PART_BITS[p]
            other |= _bits(fp, a, b) << width
            width += b - a
    width = min(width, max(0, len(fp).bit_length() - 5))
    group = (other & ((1 << width) - 1)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=1 << width))))
    fp = fp[order]
    table = pivot_table(fp, REFERENCE)
    half = np.ascontiguousarray(fp[:, 1 if sum(CHUNK_BITS[chunk]) < 128 else 0])
    for i, j in _candidates(half, starts, _few_bits(width), radius):
        i, j, d = _within(fp, table, i[i < j], j[i < j], radius)
        if len(i):
            yield order[i], order[j], d


def _first_part(fp_a: np.ndarray, fp_b: np.ndarray, part: int) -> np.ndarray:
    """Whether ``part`` is the first that agrees, of the first chunk with at most ``SPARE`` bits that differ: each pair is then
    reported once."""
    differ = fp_a ^ fp_b
    chunk = part // (SPARE + 1)
    first = np.ones(len(differ), bool)
    for c in range(chunk + 1):
        first &= (hamming(differ & CHUNK_MASKS[c], np.uint64(0)) <= SPARE) == (c == chunk)
    for p in range(chunk * (SPARE + 1), part + 1):
        first &= ((differ & MASKS[p]) == 0).all(axis=1) == (p == part)
    return first


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (key, id, f0, f1) sorted by key, which is a part's number and its value. (a, b, distance) of verified pairs."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        key = rows[:, 0]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
            if e - s < 2:
                continue
            part, ids, fp = int(key[s]) >> VALUE_BITS, rows[s:e, 1], np.ascontiguousarray(rows[s:e, 2:]).view(np.uint64)
            for i, j, d in part_pairs(fp, part):
                fresh = _first_part(fp[i], fp[j], part)
                yield ids[i[fresh]], ids[j[fresh]], d[fresh]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        cut_at = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))  # the last bucket may go on in the next batch
        if cut_at:
            yield from solve(np.concatenate([*held, rows[:cut_at]]))
            held = []
        held.append(rows[cut_at:])
    if held:
        yield from solve(np.concatenate(held))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All verified pairs."""
    held, total = [], 0
    for found in _found(batches):
        held.append(found)
        total += len(found[0])
        if total >= EDGES:
            yield _batch(held)
            held, total = [], 0
    if total:
        yield _batch(held)


def _batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], EDGE.names)


def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same ids as the edges (a, b): the least id of each component with each other one."""
    ids, x = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = x[: len(a)], x[len(a) :]
    label = np.arange(len(ids))
    while len(i):
        u, v = label[i], label[j]
        apart = u != v
        i, j, u, v = i[apart], j[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(label, up := label[label]):
            label = up
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[other]], ids[other]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What connects the same ids as the verified pairs do. Copies of copies make pairs by the square, these are few an id."""
    held, total = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])

    for a, b, _ in _found(batches):
        held.append((a, b))
        total += len(a)
        if total >= EDGES:
            held = [trees(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            total = len(held[0][0])
            if total > EDGES // 2:
                yield batch()
                held, total = [], 0
    if total:
        held = [trees(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        yield batch()


def _met(nodes: DataFrame) -> DataFrame:
    """(key, id, f0, f1) of every row (id, f0, f1) for each of its parts, sorted by key. One shuffle."""
    keys = []
    for part, (a, b) in enumerate(PART_BITS):
        value = F.shiftrightunsigned(f"f{a // 64}", a % 64)
        if a // 64 != (b - 1) // 64:
            value = value.bitwiseOR(F.shiftleft("f1", 64 - a))
        keys.append(value.bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(part << VALUE_BITS))
    rows = nodes.select(F.explode(F.array(*keys)).alias("key"), "id", "f0", "f1")
    return rows.repartition("key").sortWithinPartitions("key")


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Edges (a, b, distance) between rows (id, f0, f1) of distinct fingerprints within ``RADIUS``: all of them."""
    return _met(nodes).mapInArrow(_pairs, EDGE)


def near_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same rows as those of ``near_pairs``: of the pairs that a task finds only what its components need."""
    return _met(nodes).mapInArrow(_links, LINK)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of an edge: the least id that it is connected to. Rounds of neighbour minimum and pointer jump."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    both = cut(both.distinct(), "neighbours")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("further"))
        step = step.join(jump, "next").select("u", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("moved"))
        step = cut(step, "labels")
        labels = step.select("u", "label")
        if step.where("moved").isEmpty():
            return labels.select(F.col("u").alias("id"), "label")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the id that stays), group_size (rows) and keep, for every row of ``docs``."""
    prints = cut(fingerprints(docs), "fingerprints")
    known = prints.where("doc_id IS NOT NULL AND f0 IS NOT NULL")
    nodes = cut(known.groupBy("f0", "f1").agg(F.min("doc_id").alias("id")), "nodes")
    # an id with several texts ties its nodes together
    ids = known.join(nodes, ["f0", "f1"]).select("doc_id", "id")
    ties = ids.groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("bs")).where(F.size("bs") > 1).select("a", F.explode("bs").alias("b")).where("a < b")
    edges = cut(near_links(nodes).unionByName(ties), "edges")
    if edges.isEmpty():
        grouped = ids.select("doc_id", F.col("id").alias("group_id"))
    else:
        grouped = ids.join(components(edges), "id", "left").select("doc_id", F.coalesce("label", "id").alias("group_id"))
    lone = prints.where("doc_id IS NULL OR f0 IS NULL").select("doc_id", F.col("doc_id").alias("group_id"))
    found = grouped.unionByName(lone)
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("group_size"))
    found = found.join(sizes, "group_id", "left")
    return found.select("doc_id", "group_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("keep"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id stays; of those that repeat an id one, that of the least text hash
    (null text last; rows equal in id and text are told apart by the hash of all their columns)."""
    decided = cut(groups(docs), "groups")
    gone = cut(decided.where("NOT keep").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    repeated = decided.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again")
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left["doc_id"] == repeated["__again"], "left_anti")
    many = left.join(repeated, left["doc_id"] == repeated["__again"], "left_semi")
    # the row is one struct, so that no name of its columns meets ours; max_by keeps one row an id, on both sides of the shuffle
    rank = F.struct(F.coalesce(F.xxhash64(F.col("row.text").cast("string")), F.lit(2**63 - 1)), F.xxhash64("row"))
    least = many.select(F.struct(*[many[c] for c in docs.columns]).alias("row")).groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", rank).alias("row"))
    return once.unionByName(least.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
