"""Temperature mixing of sources: shares to the power of a bisected exponent, realised as budgeted block permutations.

The share of each source among all words is raised to ``alpha`` and normalised. ``alpha`` in [0, 1] is bisected so that the
entropy of the weights is ``ENTROPY`` of the most possible (where the plain shares reach it already, alpha is 1), and then raised
as far as needed for no source to be repeated more than ``MAX_PASSES`` times. Each source's words are cut by a hash into blocks of
about ``BLOCK_WORDS``; each pass over a source takes all its blocks in a permutation of its own; the last pass stops where the
source's budget is met, in the midst of a block if need be, and no source gets more words than its budget. ``mix_rank`` in [0, 1)
orders the rows so that any prefix of the mixture holds the sources in about their weights.

Defined results
* null ``source``: a source of its own; null ``doc_id``: drawn like any other, placed by its text; null or blank texts: 0 words,
  drawn in each full pass of their block; a source of 0 words has weight 0 and is drawn once; repeated rows (and rows that repeat
  an id in a source) lie in one block and are drawn alike, but for the block where the budget ends;
* one source, or sources of equal size: the weights are the shares; extra columns, whatever their names, are kept (``drawn``) or
  ignored (``mix``); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.op7_packing import words_of
from clausewright.session import cut, require

ENTROPY = 0.97
MAX_PASSES = 4.0
BLOCK_WORDS = 100_000
SEED = 11
#: Blocks of a source that are summed in one go.
SPAN = 10_000
#: Block tables of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def weights(words: dict[str | None, int], budget: float, entropy: float = ENTROPY, max_passes: float = MAX_PASSES) -> tuple[float, dict[str | None, float]]:
    """(alpha, weight of each source)."""
    some = {s: n for s, n in words.items() if n > 0}
    if not some:
        return 1.0, {s: 0.0 for s in words}
    total = sum(some.values())

    def at(alpha: float) -> dict[str | None, float]:
        raised = {s: (n / total) ** alpha for s, n in some.items()}
        norm = math.fsum(raised.values())
        return {s: x / norm for s, x in raised.items()}

    def spread(alpha: float) -> float:
        return -math.fsum(w * math.log(w) for w in at(alpha).values() if w > 0)

    def passes(alpha: float) -> float:
        return max(budget * w / some[s] for s, w in at(alpha).items())

    def bisect(good, low: float, high: float) -> float:
        """The greatest alpha in [low, high] that is good, where good turns to bad once."""
        if good(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    target = entropy * math.log(len(some)) if len(some) > 1 else 0.0
    alpha = bisect(lambda a: spread(a) >= target - 1e-12, 0.0, 1.0)
    limit = max(max_passes, budget / total)
    if passes(alpha) > limit:  # repetition falls as alpha grows
        low, high = alpha, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if passes(mid) > limit else (low, mid)
        alpha = high
    return alpha, {s: at(alpha).get(s, 0.0) for s in words}


def quotas(words: dict[str | None, int], weight: dict[str | None, float], budget: int) -> dict[str | None, int]:
    """Whole words for each source, by largest remainder; ties by name."""
    exact = {s: budget * weight[s] for s in words}
    whole = {s: int(x) for s, x in exact.items()}
    rest = min(len(words), max(0, budget - sum(whole.values()))) if any(weight.values()) else 0
    for s in sorted(words, key=lambda s: (whole[s] - exact[s], s is not None, s or ""))[:rest]:
        whole[s] += 1
    return whole


def _hash(*columns: object) -> F.Column:
    return F.xxhash64(F.lit(SEED), *columns)


def _key(doc_id: F.Column, text: F.Column) -> F.Column:
    """What places a row: its id, or its text where that is null."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text.cast("string")))


def prefix_sums(rows: DataFrame, groups: list[str], value: str, order: F.Column, count: F.Column, span: int = SPAN) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``value`` over the rows of the same ``groups`` that come no later in the order of the hash
    ``order`` (ties: by block). Groups are cut into hash ranges of about ``span`` rows, summed on their own and then put
    one after the other, so that no task holds a whole group. ``count``: the rows of a group, about."""
    # 52 bits of the hash, which a double holds exactly
    rows = rows.withColumn("at", F.shiftrightunsigned(order, 12))
    rows = rows.withColumn("range", F.floor(F.col("at") / float(1 << 52) * F.ceil(count / F.lit(span))))
    sizes = rows.groupBy(*groups, "range").agg(F.sum(value).alias("of_range"))
    before = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("of_range").over(before), F.lit(0))).drop("of_range")
    sizes = sizes.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("range").alias("of_range"), "before")
    same = F.col("range") == F.col("of_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    inside = Window.partitionBy(*groups, "range").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("local", F.sum(value).over(inside))
    return local.join(sizes, same).withColumn("upto", F.col("before") + F.col("local")).drop("at", "range", "before", "local", "of_range", *[f"of_{g}" for g in groups])


def source_plan(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_passes: float = MAX_PASSES) -> DataFrame:
    """source, words, alpha, weight and quota of every source: what ``draw`` realises."""
    totals = {r["source"]: r["n"] for r in require(docs, {"source": T.StringType(), "text": T.StringType()}).groupBy("source").agg(F.sum(words_of().cast("long")).alias("n")).collect()}
    budget = sum(totals.values()) if budget is None else budget
    alpha, weight = weights(totals, budget, entropy, max_passes)
    quota = quotas(totals, weight, budget)
    return docs.sparkSession.createDataFrame([(s, n, alpha, weight[s], quota[s]) for s, n in totals.items()], "source string, words long, alpha double, weight double, quota long")


def draw(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of ``docs`` as often as it is drawn, as ``row`` (a struct of all its columns) with ``pass``, ``block`` and ``mix_rank``."""
    spark = docs.sparkSession
    items = require(docs, {"doc_id": T.LongType(), "source": T.StringType(), "text": T.StringType()})
    items = cut(items.select("source", _key(F.col("doc_id"), F.col("text")).alias("key"), words_of().cast("long").alias("words")), "lengths")
    totals = {r["source"]: r["n"] for r in items.groupBy("source").agg(F.sum("words").alias("n")).collect()}  # one row a source
    budget = sum(totals.values()) if budget is None else budget
    quota = quotas(totals, weights(totals, budget, entropy, max_passes)[1], budget)
    facts = [(s, n, quota[s], max(1, -(-n // block_words)), quota[s] // n if n else 1) for s, n in totals.items()]
    sources = spark.createDataFrame(facts, "source string, total long, quota long, blocks long, full long")
    if len(facts) <= BROADCAST_ROWS:
        sources = F.broadcast(sources)

    placed = items.alias("i").join(sources.alias("s"), F.expr("i.source <=> s.source")).select("s.*", "i.key", "i.words")
    blocks = placed.withColumn("block", F.pmod(_hash(F.col("key"), F.col("source")), F.col("blocks")))
    blocks = blocks.groupBy("source", "total", "quota", "full", "blocks", "block").agg(F.sum("words").alias("words"))
    partial = F.when((F.col("quota") > F.col("full") * F.col("total")), F.col("full")).otherwise(F.col("full") - 1)
    turns = blocks.withColumn("turn", F.explode(F.expr("sequence(0L, full, 1L)"))).where(F.col("turn") <= partial)
    turns = prefix_sums(turns, ["source", "turn"], "words", _hash(F.lit("order"), F.col("source"), F.col("turn"), F.col("block")), F.col("blocks"))
    room = F.col("quota") - F.col("turn") * F.col("total") - (F.col("upto") - F.col("words"))  # what the budget has left for the block
    start = (F.col("turn") * F.col("total") + F.col("upto") - F.col("words")) / F.greatest(F.col("quota"), F.lit(1))
    turns = turns.withColumn("room", room).withColumn("rank", start)
    span = F.when(F.col("turn") >= F.col("full"), F.least("words", "room")).otherwise(F.col("words"))  # a torn block ends where the budget does
    turns = cut(turns.where("turn < full OR room > 0").select("source", "block", "turn", "rank", (F.col("turn") >= F.col("full")).alias("last"), "room", "words", (span / F.greatest(F.col("quota"), F.lit(1))).alias("width")), "turns")
    whole, torn = turns.where("NOT last OR words <= room"), turns.where("last AND words > room")
    if turns.count() <= BROADCAST_ROWS:
        whole, torn = F.broadcast(whole), F.broadcast(torn)

    # the documents are one struct from here on, so that no name of theirs meets one of ours
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    held = held.select("row", F.col("row.source").cast("string").alias("source"), _key(F.col("row.doc_id"), F.col("row.text")).alias("key"))
    hashed = held.alias("d").join(sources.select("source", "blocks").alias("s"), F.expr("d.source <=> s.source")).select("d.*", F.pmod(_hash(F.col("d.key"), F.col("d.source")), F.col("s.blocks")).alias("block"))
    jitter = F.pmod(_hash(F.lit("within"), F.col("d.key"), F.col("t.turn")), F.lit(1 << 20)) / float(1 << 20)
    extra = [F.col("t.turn").alias("pass"), F.col("d.block").alias("block"), (F.col("t.rank") + jitter * F.col("t.width")).alias("mix_rank")]
    match = F.expr("d.source <=> t.source AND d.block = t.block")
    full = hashed.alias("d").join(whole.alias("t"), match).select("d.row", *extra)
    n_words = F.coalesce(F.regexp_count(F.col("d.row.text").cast("string"), F.lit(r"\S+")), F.lit(0))
    part = hashed.alias("d").join(torn.alias("t"), match).select("d.row", "d.source", "d.key", n_words.alias("n"), "t.room", *extra)
    inside = Window.partitionBy("source", "block", "pass").orderBy(_hash(F.lit("torn"), F.col("key")), "key").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("upto", F.sum("n").over(inside)).where(F.col("upto") <= F.col("room"))  # one block of a source
    return full.unionByName(part.select("row", "pass", "block", "mix_rank"))


def drawn(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as it is drawn."""
    return draw(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, source, pass, block and mix_rank of every drawn row."""
    found = draw(require(docs, {"doc_id": T.LongType(), "source": T.StringType(), "text": T.StringType()}), **options)
    return found.select("row.doc_id", "row.source", "pass", "block", "mix_rank")
