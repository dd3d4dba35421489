"""Small tables with what goes wrong: nulls, empty and long texts, repeated rows and columns of clashing names."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for themselves.
EXTRA = ["key", "id", "f0", "group_id", "words", "block", "turn", "rank", "score", "label", "start", "end", "__gone", "instance", "size", "shard", "total", "width", "room", "row", "pass", "__pass", "__block", "__s", "__id", "__spans", "salt", "piece", "cluster", "quota", "upto", "t", "d"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def hard_rows() -> list[tuple]:
    return [(1, None), (2, ""), (3, " \n\t "), (None, prose(1, 40)), (4, prose(2, 40), None), (5, prose(3, 60)), (5, prose(3, 60)), (6, prose(3, 60)), (7, prose(4, 30_000)), (8, "日本語 🎉 \x00 " * 20), (9, "a")]


def with_extra(df: DataFrame) -> DataFrame:
    for name in EXTRA:
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
