"""SPDX-License-Identifier tags in texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import Resolver, identify
from clausewright.functions.tokens import once

TAG = r"(?i)spdx-license-identif(?:i)?er:"
RULE_ID = "spdx-license-identifier"
MAX_BYTES = 1024
#: Bytes of the longer spelling of a tag.
LONGEST = 24
#: A worker holds no more found tags as Python objects than so many.
ROWS_AT_ONCE = 10_000
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("expression", T.StringType()), T.StructField("license_ids", T.ArrayType(T.StringType())), T.StructField("identification", T.StringType())]
)
_TAG = re.compile(rb"(?i)spdx-license-identif(?:i)?er:")
_END = re.compile(rb"[\n\r]|\*/|-->")


def tags(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start of the tag, end of the expression, expression) of each tag with an expression, from left to right, in bytes."""
    at = 0
    while m := _TAG.search(data, at):
        limit = min(len(data), m.end() + MAX_BYTES)
        stop = _END.search(data, m.end(), limit)
        raw = data[m.end() : stop.start() if stop else limit]
        body = raw.rstrip(b" \t")
        end = m.end() + len(body)
        body = body.lstrip(b" \t")
        at = max(end, m.end())
        if body:
            yield m.start(), end, body


def _parts(text: Column) -> Column:
    """The text cut before each tag: bytes of each part, and as ``head`` what a tag and its expression may take of it, null where a
    part begins with no tag. Nothing else of a text plays a role in its tags."""
    head = lambda p: F.when(F.substring(p, 1, LONGEST).rlike(f"^{TAG}"), F.substring(p.cast("binary"), 1, LONGEST + MAX_BYTES))
    return F.transform(F.split(text, f"(?={TAG})", -1), lambda p: F.struct(F.octet_length(p).alias("bytes"), head(p).alias("head")))


def tags_of_parts(parts: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    """``tags`` of the text that was cut. A head that is cut short reaches over the limit of its expression, so that no tag begins or
    ends beyond it; one that isn't is followed by the next as in the text."""
    places, shifts, at, held = [], [], 0, 0
    for p in parts:
        if p["head"] is not None:
            places.append(held)
            shifts.append(at - held)
            held += len(p["head"])
        at += p["bytes"]
    for start, end, raw in tags(b"".join(p["head"] for p in parts if p["head"] is not None)):
        shift = shifts[bisect_right(places, start) - 1]
        yield start + shift, end + shift, raw


def find_tags(docs: DataFrame, resolver: Resolver, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each tag whose expression is valid and whose identifiers are all known. Of a text only what follows a tag reaches
    Python, and nothing of a text without one."""
    shared = docs.sparkSession.sparkContext.broadcast(resolver)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, parts in zip(batch.column(0), batch.column(1), strict=True):
                for start, end, raw in tags_of_parts(parts.as_py()):
                    body = raw.decode("utf-8", "replace")
                    expression, ids, keys = shared.value.normalize(body)
                    if expression:
                        rows.append((doc.as_py(), start, end, body, expression, ids, identify(keys)))
                        if len(rows) >= ROWS_AT_ONCE:
                            yield whole(rows)
                            rows = []
            yield whole(rows)

    rows = once(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "parts", _parts(F.col("text")))
    return rows.where(F.exists("parts", lambda p: p["head"].isNotNull())).select("doc_id", "parts").mapInArrow(run, SCHEMA)


def drop_covered(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Tags that overlap no rule match (detection or clue) of their document."""
    return found.alias("t").join(matches.alias("m"), F.expr("m.doc_id = t.doc_id AND m.start < t.end AND t.start < m.end"), "left_anti")


def without_covered(both: DataFrame) -> DataFrame:
    """Rule matches and tags (``is_tag``) without the tags that a rule match of their document overlaps: one that begins no later than
    the tag and ends behind its start, or the first that begins later. Both are running values, so rows are sorted, not paired."""
    rule = lambda c: F.when(~F.col("is_tag"), F.col(c))
    window = lambda order: Window.partitionBy("doc_id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach, later = F.max(rule("end")).over(window(F.col("start"))), F.min(rule("start")).over(window(F.col("start").desc()))
    covered = F.col("is_tag") & F.col("doc_id").isNotNull() & ((F.col("reach") > F.col("start")) | (F.col("later") < F.col("end")))
    return both.withColumn("reach", reach).withColumn("later", later).where(~F.coalesce(covered, F.lit(False))).drop("reach", "later")


def as_matches(found: DataFrame) -> DataFrame:
    """Tags in the columns of rule matches."""
    return found.select("doc_id", F.lit(RULE_ID).alias("rule_id"), "expression", "license_ids", "identification", F.lit("tag").alias("kind"), F.lit("spdx-id").alias("method"), F.lit(100.0).alias("score"), F.lit(100.0).alias("coverage"), "start", "end", F.lit(False).alias("is_clue"))
