"""Quality rules: hashed word and character n-gram logistic regression with calibrated probabilities and fixed thresholds.

Defined results
* null or empty text, or text without features: scored by the bias alone, so by the share of good rows among the labels;
* null ``doc_id``: scored like any other row; repeated rows: each is scored, with equal results;
* labels that are null, name no document of the table or are not 0 or 1 are not used, nor counted; a document that is labelled
  both 0 and 1 is a sample of both; of several texts under one id the least is the sample;
* no labels of one of the classes (or none at all): every document gets ``p_quality`` 1.0 where no bad label exists and 0.0
  where no good label exists (1.0 where there are none), with that score's verdict;
* extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import linear, textvec
from clausewright.session import cut, require

DIMS = 1 << 18
CHARS = (2, 4)
SCALE = 30.0
#: Features of weight 0 that each text has besides its own, so that a few words decide little.
SMOOTH = 16.0
KEEP, REJECT = 0.5, 0.2
#: Labelled rows of each class that the model is fitted on, at most.
MAX_PER_CLASS = 2000
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("p_quality", T.DoubleType()), T.StructField("verdict", T.StringType())])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def probability(self, score: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(score), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -60, 60)))


def _word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, owner, _, _ = textvec.words(texts, case=True)
    pairs, pair_owner = textvec.word_ngrams(h, owner, 2)
    if len(h) > 1:
        same = (h[1:] == h[:-1])[owner[1:] == owner[:-1]]
        pairs = np.where(same, np.uint64(1), pairs)  # a word said twice is one feature, whichever word it is
    return (np.concatenate((h, pairs)) % np.uint64(DIMS)).astype(np.int64), np.concatenate((owner, pair_owner))


def _char_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in CHARS:
        for h, owner in textvec.char_ngrams(texts, n):
            yield (h % np.uint32(DIMS)).astype(np.int64), owner


def features(texts: list[str | None]) -> linear.Blocks:
    rows = linear.Blocks(len(texts))
    for first, run in textvec.groups(texts, 1 << 15):  # short runs: all features of a run are sorted at once
        chars = list(_char_buckets(run))
        for buckets, owner in (_word_buckets(run), tuple(np.concatenate(x) for x in zip(*chars, strict=True)) if chars else (np.zeros(0, np.int64),) * 2):
            rows.add(linear.Rows.counted(buckets, owner, len(run), DIMS, SCALE, SMOOTH).shifted(first, len(texts)))
    return rows.close()


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """bias + SCALE * (mean weight of the word features + mean weight of the character features), each mean over SMOOTH more features of weight 0."""
    out = np.full(len(texts), bias)
    for first, run in textvec.groups(texts):
        buckets, owner = _word_buckets(run)
        for source in ([(buckets, owner)], _char_buckets(run)):
            total, count = np.zeros(len(run)), np.zeros(len(run))
            for b, o in source:
                total += np.bincount(o, weights[b], len(run))
                count += np.bincount(o, minlength=len(run))
            out[first : first + len(run)] += SCALE * total / (count + SMOOTH)
    return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> tuple[list[str | None], np.ndarray, dict[int, int]]:
    """At most ``per_class`` labelled texts of each class, chosen by a hash of ``doc_id``, and the classes' counts among the labels
    of documents that are there. Of several texts under one id the least in string order is taken."""
    known = require(labels, {"doc_id": T.LongType(), "quality": T.IntegerType()}).where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    texts = require(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    known = cut(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "labels")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = found.toPandas().sort_values(["doc_id", "quality"])  # 2 * per_class rows, at most
    return found["text"].tolist(), found["quality"].to_numpy(int), counts


def train(texts: list[str | None], quality: np.ndarray, counts: dict[int, int], steps: int = 60) -> Model:
    if len(set(quality.tolist())) < 2:
        only = set(quality.tolist()) or set(counts)
        return Model(np.zeros(DIMS, np.float32), 0.0, 1.0, 0.0, 0.0 if only == {0} else 1.0)
    rows = features(texts)
    held = np.arange(len(texts)) % 5 == 4
    if len(set(quality[held].tolist())) < 2:
        held[:] = False
    share = np.where(quality == 1, counts.get(1, 1) / max(1, (quality == 1).sum()), counts.get(0, 1) / max(1, (quality == 0).sum()))
    fitted = ~held
    balance = np.where(quality == 1, 0.5 / max(1, (quality[fitted] == 1).sum()), 0.5 / max(1, (quality[fitted] == 0).sum()))
    w, b = linear.fit(rows, quality, 2, DIMS, steps=steps, weight=balance * fitted)
    weights, bias = (w[:, 1] - w[:, 0]).astype(np.float32), float(b[1] - b[0])
    check = held if held.any() else ~held
    score = rows.dot(weights[:, None].astype(float))[:, 0] + bias
    slope, shift = linear.platt(score[check], quality[check], (share / share.mean())[check])
    return Model(weights, bias, slope, shift)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, p_quality and verdict (keep, review, reject) of every row. One narrow pass; texts stay where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in textvec.sliced(batches):
            s = scores(batch.column(1).to_pylist(), m.weights, m.bias)
            p = m.probability(s)
            verdict = np.where(p >= KEEP, "keep", np.where(p >= REJECT, "review", "reject"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(p), pa.array(verdict.tolist(), pa.string())], ["doc_id", "score", "p_quality", "verdict"])

    return require(docs, {"doc_id": T.LongType(), "text": T.StringType()}).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    return score_documents(docs, train(*sample(docs, labels, per_class)))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected. Scored and filtered in the same pass over the rows."""
    model = train(*sample(docs, labels, per_class))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in textvec.sliced(batches):
            p = m.probability(scores(batch.column(at).to_pylist(), m.weights, m.bias))
            yield batch.filter(pa.array(p >= REJECT))

    return docs.mapInArrow(run, docs.schema)
