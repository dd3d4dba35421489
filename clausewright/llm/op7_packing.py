"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

A document is cut into pieces of at most ``CAPACITY`` words. Pieces, the longest first, go to the open bin of least sufficient
room that is compatible: it holds no piece of the same duplicate cluster, and its source has not reached its limit there. The
limit of a source is ``SOURCE_SLACK`` times its mean number of pieces in a bin, were the shard's bins full, and ``PER_SOURCE`` at
least: sources are spread over the bins, and one that makes up most of a shard (or all of it) is not held back by a number that
would leave its bins empty. Bins are kept by residual in a balanced tree and carry two bitmaps, one bit for each cluster and unary
bits for each source; the successor search goes on from residual to residual until a compatible bin is found. Sources and clusters
of ``HOT`` of a shard's pieces or more have a tree of their own, of the bins that still take them, so that bins which they have
filled aren't visited again; the bins found are the same.

Pieces are spread over shards of about ``SHARD_PIECES`` by a hash and each shard is packed by one task, so the work is the same
for a piece at any size of the input; pieces of different shards never meet, so the constraints hold everywhere.

Defined results
* null or blank text: no words, so no room is taken: one row with piece 0, words 0 and null bin;
* null ``source``: a source of its own; null ``doc_id``, and ids that more than a quarter of a shard's rows repeat: packed like any
  other, and spread over the shards row by row (which rows meet then depends on the order of the input files);
* repeated rows: the same cluster, so different bins; ties in length: by doc_id, then piece, nulls first; extra columns are
  ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.balanced import Successors
from clausewright.session import cut, require

CAPACITY = 2048
PER_SOURCE, SOURCE_SLACK = 4, 2.0
HOT = 0.05
SHARD_PIECES = 20_000
SCHEMA = "doc_id long, piece int, first_word long, words int, bin_id long, bin_offset int"


def words_of(text: str = "text") -> F.Column:
    """The number of runs of characters that aren't blank; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0))


def cluster_of(text: str = "text") -> F.Column:
    """Texts that differ in case and white space only are one duplicate cluster."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", " "))


class Bins:
    """Open bins by residual, those of one residual in the order of their last change."""

    def __init__(self, capacity: int):
        self.tree, self.rows = Successors(capacity + 1), [{} for _ in range(capacity + 1)]

    def put(self, b: int, room: int) -> None:
        if room:
            if not self.rows[room]:
                self.tree.add(room)
            self.rows[room][b] = None

    def take(self, b: int, room: int) -> None:
        if self.rows[room].pop(b, 0) is None and not self.rows[room]:
            self.tree.discard(room)

    def find(self, size: int, fits: Callable[[int], bool]) -> tuple[int, int]:
        """(bin, residual) of the tightest bin with room that fits, or (-1, -1)."""
        room = self.tree.successor(size)
        while room >= 0:
            for b in self.rows[room]:
                if fits(b):
                    return b, room
            room = self.tree.successor(room + 1)
        return -1, -1


def source_limits(sizes: list[int], sources: list[int], capacity: int, per_source: int | None = None) -> list[int]:
    """Pieces of each source that a bin may hold; ``per_source`` replaces the limit by one number for all sources."""
    counts = np.bincount(np.array(sources, np.int64)) if sources else np.zeros(0, np.int64)
    if per_source is not None:
        return [per_source] * len(counts)
    full = max(1, -(-sum(sizes) // capacity))
    return [max(PER_SOURCE, math.ceil(SOURCE_SLACK * n / full)) for n in counts.tolist()]


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, limits: list[int], hot: float = HOT) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece, in the order given. A cluster of -1 conflicts with nothing; sources are small integers."""
    shift = [0, *np.cumsum(limits).tolist()]
    least = max(2, math.ceil(hot * len(sizes)))
    everything = Bins(capacity)
    of_source = {s: Bins(capacity) for s, n in Counter(sources).items() if n >= least}
    of_cluster = {c: Bins(capacity) for c, n in Counter(clusters).items() if n >= least and c >= 0}
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    residual: list[int] = []
    bins, offsets = [], []
    for size, cluster, source in zip(sizes, clusters, sources, strict=True):
        mark = 1 << cluster if cluster >= 0 else 0
        last = 1 << (shift[source] + limits[source] - 1)
        where = of_cluster.get(cluster) or of_source.get(source) or everything
        chosen, room = where.find(size, lambda b: not cluster_bits[b] & mark and not source_bits[b] & last)  # noqa: B023
        if chosen < 0:
            chosen, room = len(residual), capacity
            residual.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
        unary = source_bits[chosen] >> shift[source] & ((1 << limits[source]) - 1)
        source_bits[chosen] |= (unary + 1) << shift[source]
        cluster_bits[chosen] |= mark
        bins.append(chosen)
        offsets.append(capacity - room)
        left = residual[chosen] = room - size
        everything.take(chosen, room)
        everything.put(chosen, left)
        for s, view in of_source.items():
            view.take(chosen, room)
            if not source_bits[chosen] >> (shift[s] + limits[s] - 1) & 1:
                view.put(chosen, left)
        for c, view in of_cluster.items():
            view.take(chosen, room)
            if not cluster_bits[chosen] >> c & 1:
                view.put(chosen, left)
    return bins, offsets


def _pack_shard(rows: pd.DataFrame, capacity: int, per_source: int | None) -> pd.DataFrame:
    order = np.lexsort((rows["piece"], rows["doc_id"].fillna(-(2**62)).to_numpy(np.int64) if rows["doc_id"].isna().any() else rows["doc_id"], -rows["words"]))
    rows = rows.iloc[order]
    number, count = np.unique(rows["cluster"].to_numpy(), return_inverse=True, return_counts=True)[1:]
    dense = np.full(len(count), -1)
    dense[count > 1] = np.arange((count > 1).sum())  # a cluster of one piece can't conflict
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    sizes = rows["words"].tolist()
    bins, offsets = best_fit(sizes, dense[number].tolist(), sources.tolist(), capacity, source_limits(sizes, sources.tolist(), capacity, per_source))
    base = rows["shard"].to_numpy(np.int64) << 32
    return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "first_word": rows["piece"].astype("int64") * capacity, "words": rows["words"], "bin_id": base + np.array(bins, np.int64), "bin_offset": np.array(offsets, np.int32)})


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of each document: its words and the bin and offset that they go to."""
    items = require(docs, {"doc_id": T.LongType(), "source": T.StringType(), "text": T.StringType()})
    items = cut(items.select("doc_id", "source", words_of().alias("total"), cluster_of().alias("cluster"), F.monotonically_increasing_id().alias("row")), "lengths")
    # ids that would fill a shard by themselves are spread by row
    heavy = items.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).count().where(F.col("count") > max(1, shard_pieces // 4)).select("id")
    salt = F.when(F.col("doc_id").isNull(), F.col("row"))
    if not heavy.isEmpty():
        items = items.join(heavy, F.col("doc_id") == F.col("id"), "left")
        salt = F.when(F.col("doc_id").isNull() | F.col("id").isNotNull(), F.col("row"))
    pieces = items.where("total > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / capacity).cast("int"))))
    pieces = pieces.select("doc_id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("words"), salt.alias("salt"))
    shards = max(1, -(-pieces.count() // shard_pieces))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(7)), F.lit(shards))).drop("salt")
    packed = pieces.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, capacity, per_source), SCHEMA)
    blank = items.where("total = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"), F.lit(0).alias("words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(blank)
