"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``; the last returns one row for each packed piece.

Defined results, of every stage: null ids and null or empty texts are rows like any other; extra columns, whatever their names, come
out as they went in (all stages but the last); an empty table gives no rows. What ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import op1_quality, op6_neardup, op7_packing, op9_pii, op10_mixing
from clausewright.session import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Repeated rows stay or go alike; an empty text is judged by the share of good labels."""
    return op1_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays. Of rows that repeat an id one stays, that of the least text
    hash; rows with a null id or a text without words are in no group and stay, all of them."""
    return op6_neardup.drop_copies(docs)


def personal_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their type; ``n_chars`` follows the text (where that is null it stays). No row goes."""
    masked = op9_pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture draws it, within a budget of as many words as come in. Null sources are a source of their
    own; repeated rows are drawn alike, but for the block where the budget ends; texts without words go with their block."""
    return op10_mixing.drawn(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of each piece of each document; a text without words is one piece of 0 words in no bin. Copies drawn by
    the mixture lie in different bins; ties in length go by id, then piece."""
    return op7_packing.pack(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("PII", personal_identifiers), ("mixing", mixing), ("best-fit packing", packing)]

#: The stages fit a model, search by hashes and pack greedily: SQL can't express them (tests compare with brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
