"""A policy gate over expressions: denied and allowed identifiers, the files at fault, and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(text: str) -> list[str]:
    """A comma-separated list, lower-cased and trimmed."""
    return [x for x in (part.strip().lower() for part in text.split(",")) if x]


def plain_ids(expression: Column) -> Column:
    """Lower-case words of an expression without parentheses and operators."""
    words = F.split(F.regexp_replace(F.lower(expression), "[()]", " "), " ")
    return F.filter(words, lambda w: ~w.isin("", "and", "or", "with"))


def is_denied(expression: Column, deny: str = "", allow: str = "") -> Column:
    """Whether any identifier is on the deny list, or any is missing from a non-empty allow list."""
    ids, denied, allowed = plain_ids(expression), names(deny), names(allow)
    out = F.lit(False)
    if denied:
        out = out | F.exists(ids, lambda i: i.isin(*denied))
    if allowed:
        out = out | F.exists(ids, lambda i: ~i.isin(*allowed))
    return out


def denies(expression: str, deny: str = "", allow: str = "") -> bool:
    """is_denied() for one expression in plain Python."""
    ids = [w for w in expression.lower().replace("(", " ").replace(")", " ").split(" ") if w not in ("", "and", "or", "with")]
    denied, allowed = names(deny), names(allow)
    return any(i in denied for i in ids) or bool(allowed) and any(i not in allowed for i in ids)


def annotations(expressions: DataFrame, detections: DataFrame, deny: str = "", allow: str = "") -> DataFrame:
    """(path, expression) of the files with a denied expression. detections: path, expression."""
    bad = expressions.where(is_denied(F.col("expression"), deny, allow)).select("expression").distinct()
    return detections.select("path", "expression").join(bad, "expression", "left_semi").distinct()


def summary_lines(expressions: DataFrame) -> DataFrame:
    """expression, files and matches, the most files first."""
    return expressions.select("expression", "files", "matches").orderBy(F.desc("files"), "expression")
