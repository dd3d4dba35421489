"""Filters between candidates and matches: contained, overlapping, restored and false-positive candidates.

``contained`` and ``restore`` are set operations on windows and anti joins. The greedy overlap pass depends on the order of its
own removals, so it is a fold over the candidates of one document; ``filter_hits`` and ``filter_states`` run all steps in one such
fold over the rows of ``match.hits``, each of which holds all candidates of its document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clausewright.operators import match
from clausewright.operators.rules import FALSE_POSITIVE

SAME_LICENCE, ANY_LICENCE, NEARLY_ALL = 0.40, 0.70, 0.90
#: A worker holds no more hits as Python objects than so many, and those of one document.
HITS_AT_ONCE = 20_000
STATES = ("active", "contained", "overlapping", "final")


@dataclass(frozen=True)
class Options:
    contained: bool = True
    overlapping: bool = True
    false_positive: bool = True


def order() -> list:
    """The order of all filters: by start, the longest first, then by rule."""
    return [F.col("tok_start"), (F.col("tok_end") - F.col("tok_start")).desc(), F.col("rule_index")]


def contained(found: DataFrame) -> DataFrame:
    """``found`` with ``is_contained``: it ends no later than a candidate before it. A dropped row never raises the running maximum,
    so the maximum over all earlier rows equals that over the kept ones."""
    before = Window.partitionBy("doc_id").orderBy(*order()).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("is_contained", F.coalesce(F.col("tok_end") <= F.max("tok_end").over(before), F.lit(False)))


def restore(active: DataFrame, discarded: DataFrame) -> DataFrame:
    """The discarded candidates that overlap no active one."""
    a, d = active.alias("a"), discarded.alias("d")
    return d.join(a, F.expr("a.doc_id = d.doc_id AND a.tok_start < d.tok_end AND d.tok_start < a.tok_end"), "left_anti")


def without_false_positives(found: DataFrame) -> DataFrame:
    return found.where(F.col("flags").bitwiseAND(F.lit(FALSE_POSITIVE)) == 0)


Span = tuple[int, int, int, str, int]  # start, end, rule, expression, flags


def _overlap(a: Span, b: Span) -> int:
    return max(0, min(a[1], b[1]) - max(a[0], b[0]))


def loser(a: Span, b: Span, before: Span | None) -> str:
    """Which of two overlapping candidates, a before b, goes: 'current' (a), 'next' (b) or ''. ``before``: the last one kept before a."""
    shared = _overlap(a, b)
    if not shared or a[4] & b[4] & FALSE_POSITIVE:
        return ""
    len_a, len_b = a[1] - a[0], b[1] - b[0]
    of_a, of_b = shared / len_a, shared / len_b
    for share in (NEARLY_ALL, ANY_LICENCE):
        if of_b >= share and len_a >= len_b:
            return "next"
        if of_a >= share and len_a <= len_b:
            return "current"
    if a[3] == b[3] and max(of_a, of_b) >= SAME_LICENCE:
        return "next" if len_a >= len_b else "current"
    if before is not None and not _overlap(before, b) and _overlap(a, before) + shared >= len_a * NEARLY_ALL:
        return "current"
    return ""


def fold_overlaps(rows: list[Span], state: list[str] | None = None) -> list[str]:
    """The greedy pass over the active rows, each compared with those after it that it reaches. Changes and returns ``state``."""
    state = ["active"] * len(rows) if state is None else state
    kept: Span | None = None
    for i, row in enumerate(rows):
        if state[i] != "active":
            continue
        for j in range(i + 1, len(rows)):
            if state[j] != "active":
                continue
            if rows[j][0] >= row[1]:
                break
            goes = loser(row, rows[j], kept)
            if goes == "next":
                state[j] = "overlapping"
            elif goes == "current":
                state[i] = "overlapping"
                break
        if state[i] == "active":
            kept = row
    return state


def fold(rows: list[Span], options: Options = Options()) -> list[str]:
    """The final state of each candidate of a document; ``rows`` in order()."""
    state = ["active"] * len(rows)

    def drop_contained(mark: str) -> None:
        reach = -1
        for i, row in enumerate(rows):
            if state[i] == "active":
                if row[1] <= reach:
                    state[i] = mark
                else:
                    reach = row[1]

    def bring_back(mark: str) -> None:
        active = [rows[i] for i in range(len(rows)) if state[i] == "active"]  # starts ascend
        at = 0
        back = []
        for i, row in enumerate(rows):
            if state[i] != mark:
                continue
            while at < len(active) and active[at][1] <= row[0]:
                at += 1
            if at == len(active) or active[at][0] >= row[1]:
                back.append(i)
        for i in back:
            state[i] = "active"

    if options.contained:
        drop_contained("contained")
    if options.overlapping:
        fold_overlaps(rows, state)
    bring_back("contained")
    bring_back("overlapping")
    if options.contained:
        drop_contained("final")
    if options.false_positive:
        for i, row in enumerate(rows):
            if state[i] == "active" and row[4] & FALSE_POSITIVE:
                state[i] = "final"
    return state


def filter_states(found: DataFrame, rules: DataFrame, options: Options = Options()) -> DataFrame:
    """The candidates of ``match.hits`` with the ``state`` of each. Nothing is shuffled: a document's candidates are one row."""
    return _folded(found, rules, lambda rows: fold(rows, options))


def filter_overlaps(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The candidates that the contained filter keeps, with state 'overlapping' where the greedy pass drops one; nothing is restored."""
    def states(rows: list[Span]) -> list[str]:
        state = fold(rows, Options(overlapping=False, false_positive=False))
        return fold_overlaps(rows, ["contained" if x != "active" else x for x in state])

    return _folded(found, rules, states).where("state <> 'contained'")


def filter_hits(found: DataFrame, rules: DataFrame, options: Options = Options()) -> DataFrame:
    """``match.hits`` with the surviving hits only, and only documents that have some."""
    return _fold_rows(found, rules, lambda rows: fold(rows, options), found.schema, lambda hits, states: [h for h, s in zip(hits, states, strict=True) if s == "active"])


def kept_by(found: DataFrame, rules: DataFrame, options: list[Options]) -> DataFrame:
    """doc_id, rule_index and ``kept`` of the candidates of ``match.hits``, once a document and rule: bit k is set where a candidate of
    the rule survives options[k]. Each document is folded under all of them where it is read, once."""
    def masks(rows: list[Span]) -> list[int]:
        every = [fold(rows, o) for o in options]
        return [sum(1 << k for k, states in enumerate(every) if states[i] == "active") for i in range(len(rows))]

    def keep(hits: list[dict], masks: list[int]) -> list[dict]:
        by_rule: dict[int, int] = {}
        for h, mask in zip(hits, masks, strict=True):
            by_rule[h["rule_index"]] = by_rule.get(h["rule_index"], 0) | mask
        return [{"rule_index": r, "kept": mask} for r, mask in by_rule.items()]

    found = found.select("doc_id", "hits")
    element = T.StructType([T.StructField("rule_index", T.IntegerType()), T.StructField("kept", T.LongType())])
    schema = T.StructType([found.schema["doc_id"], T.StructField("hits", T.ArrayType(element))])
    return _fold_rows(found, rules, masks, schema, keep).select("doc_id", F.inline("hits"))


def _folded(found: DataFrame, rules: DataFrame, states_of: Callable[[list[Span]], list[str]]) -> DataFrame:
    element = T.StructType([*found.schema["hits"].dataType.elementType.fields, T.StructField("state", T.StringType())])
    schema = T.StructType([f if f.name != "hits" else T.StructField("hits", T.ArrayType(element)) for f in found.schema.fields if f.name != "text"])
    rows = _fold_rows(found.drop("text"), rules, states_of, schema, lambda hits, states: [h | {"state": s} for h, s in zip(hits, states, strict=True)])
    return rows.select("doc_id", "method", F.inline("hits")).select("doc_id", "rule_index", "tok_start", "tok_end", "method", "state")


def _fold_rows(found: DataFrame, rules: DataFrame, states_of: Callable[[list[Span]], list], schema: T.StructType, keep: Callable[[list[dict], list], list[dict]]) -> DataFrame:
    facts = found.sparkSession.sparkContext.broadcast(match.dictionary(rules).facts)
    at = found.columns.index("hits")
    kind = to_arrow_type(schema["hits"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = facts.value

        def part(batch: pa.RecordBatch, out: list[list[dict]], end: int) -> pa.RecordBatch:
            some = pa.array([bool(x) for x in out], pa.bool_())
            columns = batch.slice(end - len(out), len(out)).columns
            columns[at] = pa.array(out, kind)
            return pa.RecordBatch.from_arrays(columns, schema.names).filter(some)

        for batch in batches:
            out, n = [], 0
            for k, value in enumerate(batch.column(at)):
                hits = value.as_py()
                rows = [(h["tok_start"], h["tok_end"], h["rule_index"], *known[h["rule_index"]]) for h in hits]
                order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][0] - rows[i][1], rows[i][2]))
                states = states_of([rows[i] for i in order])
                out.append(keep([hits[i] for i in order], states))
                n += len(hits)
                if n >= HITS_AT_ONCE:
                    yield part(batch, out, k + 1)
                    out, n = [], 0
            yield part(batch, out, batch.num_rows)

    return found.mapInArrow(run, schema)
