"""Words of a text: lower-cased letter-or-digit runs with at most one inner or trailing plus, and where they lie in its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:\+[\p{L}\p{N}]*)?"
_GAP_AND_WORD = rf"([^\p{{L}}\p{{N}}]*)({WORD})"


def fold(word: Column) -> Column:
    """Simple, context-free lower case: a final sigma stays a sigma and a dotted I loses its dot."""
    return F.lower(F.translate(word, "Σİ", "σi"))


def tokens(text: Column) -> Column:
    """The words of a text in order. The whole text is folded before words are taken: once its sigmas and dotted I are replaced, lower
    case changes no character's class and depends on no neighbour. Null gives an empty array."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column, which is evaluated once for each row. The optimiser puts the expression of a plain column
    wherever the column is used, inside of lambdas as well, where it would be evaluated for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def token_hash(words: Column) -> Column:
    """32 bytes that stand for a word sequence; words are joined by a character that no word holds."""
    return F.unhex(F.sha2(F.array_join(words, " "), 256))


class _Offsets:
    """Bytes of words, inside one row. ``offsets(text)`` gives the bytes of the gap before each word and of the word, ``sums`` their
    totals by stretches of ``STRETCH`` words, and ``end(n)`` where the n-th word ends, from columns ``parts`` and ``sums``."""

    STRETCH = 1024

    def __call__(self, text: Column) -> Column:
        gap, word = (F.regexp_extract_all(text, F.lit(_GAP_AND_WORD), F.lit(k)) for k in (1, 2))
        return F.zip_with(gap, word, lambda g, w: F.struct(F.octet_length(g).alias("gap"), F.octet_length(w).alias("word")))

    @staticmethod
    def _total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + p["gap"] + p["word"])

    def sums(self, parts: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.floor(F.size(parts) / self.STRETCH).cast("int"))
        return F.transform(stretches, lambda k: self._total(F.slice(parts, k * self.STRETCH + 1, F.lit(self.STRETCH))))

    def end(self, n: Column) -> Column:
        full = F.floor(n / self.STRETCH).cast("int")
        before = F.aggregate(F.slice("sums", F.lit(1), full), F.lit(0).cast("long"), lambda acc, x: acc + x)
        return before + self._total(F.slice("parts", full * self.STRETCH + 1, n - full * self.STRETCH))


offsets = _Offsets()


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token, byte_start, byte_end) of every word. Offsets count bytes of the UTF-8 text."""
    both = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(_GAP_AND_WORD), F.lit(1)).alias("gap"),
        F.regexp_extract_all(F.col(text), F.lit(_GAP_AND_WORD), F.lit(2)).alias("word"),
    )
    rows = docs.select(key, F.posexplode(both).alias("pos", "part"))
    rows = rows.select(key, "pos", F.col("part.word").alias("word"), F.octet_length("part.gap").alias("gap"), F.octet_length("part.word").alias("bytes"))
    end = F.sum(F.col("gap") + F.col("bytes")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("byte_end", end)
    return rows.select(key, F.col("pos").cast("long").alias("pos"), fold(F.col("word")).alias("token"), (F.col("byte_end") - F.col("bytes")).alias("byte_start"), "byte_end")


def vocabulary(words: DataFrame, tokens_column: str = "tokens") -> DataFrame:
    """(word, id): the distinct words with lexical ids from 1. Ids come from range partitions and their sizes, not from one task."""
    distinct = words.select(F.explode(tokens_column).alias("word")).distinct()
    ordered = distinct.repartitionByRange("word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())
    local = ordered.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("word")))
    sizes = local.groupBy("part").agg(F.max("at").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = local.join(F.broadcast(before), "part")  # one row for each partition
    return joined.select("word", (F.coalesce("before", F.lit(0)) + F.col("at")).cast("long").alias("id"))
