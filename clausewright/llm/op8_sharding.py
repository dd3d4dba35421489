"""Sharding: best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Groups are the rows with equal text (one digest), their size the bytes of all their texts. Best-fit-decreasing places the groups,
the largest first, into the shard of least sufficient room, found by successor search in a balanced tree of residuals. Groups of
one size are interchangeable and follow each other, so the exact global packing needs only the number of groups of each size:
of the tightest shards each takes as many as fit, all shards of one residual at once. The driver holds one entry for each distinct
size (sizes count in units of ``UNIT`` bytes, rounded up, so there are at most ``capacity / UNIT``) and Spark gives each group,
by its rank among those of its size, the shard that the plan names. Ranks are counted in digest ranges of about ``SPAN`` groups, and
runs of the plan are joined by stretches of ``SPAN`` ranks, so that a size which many groups share is never one task. Members are
never gathered: rows learn the shard of their group by a join, by broadcast for groups of ``HOT_ROWS`` rows or more.

Defined results
* null text: a group of its own of size 0, as is the empty text; groups of size 0 take no room and go to the first shard;
* a group above the capacity gets a shard of its own, marked ``oversize``; repeated rows belong to one group;
* ties in size: by digest; null ``doc_id`` is carried along; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.balanced import Successors
from clausewright.session import cut, require

CAPACITY = 64 << 20
UNIT = 16
SPAN = 50_000
HOT_ROWS, BROADCAST_GROUPS = 10_000, 500_000
PLAN = "size long, first long, last long, each long, shard long, oversize boolean, stretch long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, bool]]:
    """Exact best-fit-decreasing of ``counts[size]`` groups: runs (size, first rank, groups a shard, first shard, oversize).

    Ranks first, first + 1, ... fill shard, shard + 1, ... with ``each`` groups a shard until the next run of that size begins.
    """
    tree = Successors(capacity + 1)
    open_shards: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual: ascending runs (first shard, number of shards)
    runs: list[tuple[int, int, int, int, bool]] = []
    shards = 0

    def put(residual: int, first: int, n: int) -> None:
        if residual and n:
            if not open_shards[residual]:
                tree.add(residual)
            bisect.insort(open_shards[residual], (first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        if size == 0:
            runs.append((0, 0, max(1, left), 0, False))
            shards = max(shards, 1)
            continue
        if size > capacity:
            runs.append((size, 0, 1, shards, True))
            shards += left
            continue
        while left:
            room = tree.successor(size)
            if room < 0:
                each = capacity // size
                n = -(-left // each)
                placed = min(left, n * each)
                runs.append((size, rank, each, shards, False))
                over = n * each - placed  # only the last shard may be left with fewer
                put(capacity - each * size, shards, n - (1 if over else 0))
                if over:
                    put(capacity - (each - over) * size, shards + n - 1, 1)
                shards += n
            else:
                first, have = open_shards[room].pop(0)
                each = room // size
                n = min(have, -(-left // each))
                placed = min(left, n * each)
                runs.append((size, rank, each, first, False))
                if have > n:
                    open_shards[room].insert(0, (first + n, have - n))
                if not open_shards[room]:
                    tree.discard(room)
                over = n * each - placed
                put(room - each * size, first, n - (1 if over else 0))
                if over:
                    put(room - (each - over) * size, first + n - 1, 1)
            rank += placed
            left -= placed
    return runs


def stretches(counts: dict[int, int], capacity: int, span: int) -> Iterator[tuple[int, int, int, int, int, bool, int]]:
    """The runs of the plan with their last rank, once for each stretch of ``span`` ranks that they reach into."""
    runs = plan(counts, capacity)
    for k, (size, first, each, number, oversize) in enumerate(runs):
        last = (runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == size else counts[size]) - 1
        for stretch in range(first // span, last // span + 1):
            yield size, first, last, each, number, oversize, stretch


def _ranked(grouped: DataFrame, counts: dict[int, int], span: int) -> DataFrame:
    """``grouped`` with ``rank``: the place of each group among those of its size, by digest."""
    spark = grouped.sparkSession
    wide = [(s, -(-n // span)) for s, n in counts.items() if n > span]
    if not wide:
        return grouped.withColumn("rank", (F.row_number().over(Window.partitionBy("size").orderBy("group_id")) - 1).cast("long"))
    ranges = F.broadcast(spark.createDataFrame(wide, "size long, ranges long"))  # one row for each span groups, at most
    # the first 32 bits of the digest; the group of a null text comes after all digests
    at = F.coalesce(F.conv(F.substring("group_id", 1, 8), 16, 10).cast("double"), F.lit(float(1 << 32)))
    rows = grouped.join(ranges, "size", "left").withColumn("range", F.floor(F.when(F.col("group_id") == "null", 1 - 1e-12).otherwise(at / float(1 << 32)) * F.coalesce("ranges", F.lit(1))))
    sizes = rows.where("ranges IS NOT NULL").groupBy("size", "range").count()
    before = sizes.select(F.col("size").alias("of_size"), F.col("range").alias("of_range"), F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "range").orderBy("group_id")) - 1
    rows = rows.withColumn("local", local).join(F.broadcast(before), (F.col("size") == F.col("of_size")) & (F.col("range") == F.col("of_range")), "left")
    return rows.select(*grouped.columns, (F.col("local") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))


def shard(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, span: int = SPAN) -> DataFrame:
    """doc_id, group_id, group_bytes, shard_id and oversize of every row."""
    spark = docs.sparkSession
    rows = require(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    rows = cut(rows.select("doc_id", F.coalesce(F.md5("text"), F.lit("null")).alias("group_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "digests")
    grouped = rows.groupBy("group_id").agg(F.sum("bytes").alias("group_bytes"), F.count("*").alias("rows"))
    grouped = cut(grouped.withColumn("size", F.ceil(F.col("group_bytes") / unit)), "groups")
    counts = {r["size"]: r["n"] for r in grouped.groupBy("size").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(list(stretches(counts, capacity // unit, span)), PLAN).alias("r")
    ranked = _ranked(grouped, counts, span).withColumn("stretch", F.floor(F.col("rank") / F.lit(span))).alias("g")
    placed = ranked.join(runs, F.expr("g.size = r.size AND g.stretch = r.stretch AND g.rank BETWEEN r.first AND r.last"))
    shard_id = F.col("r.shard") + F.floor((F.col("g.rank") - F.col("r.first")) / F.col("r.each"))
    placed = cut(placed.select(F.col("g.group_id").alias("of"), "g.group_bytes", shard_id.alias("shard_id"), "r.oversize", "g.rows"), "placed")
    out = ["doc_id", "group_id", "group_bytes", "shard_id", "oversize"]
    hot = placed.where(F.col("rows") >= HOT_ROWS)
    if hot.count() > BROADCAST_GROUPS or hot.isEmpty():
        return rows.join(placed, F.col("group_id") == F.col("of")).select(*out)
    hot = F.broadcast(hot)
    often = rows.join(hot, F.col("group_id") == F.col("of")).select(*out)
    seldom = rows.join(hot.select("of"), F.col("group_id") == F.col("of"), "left_anti")
    return often.unionByName(seldom.join(placed.where(F.col("rows") < HOT_ROWS), F.col("group_id") == F.col("of")).select(*out))
