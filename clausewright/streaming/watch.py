"""Licence matching over a stream of documents: each micro-batch runs the plan of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clausewright.functions.expressions import Resolver
from clausewright.operators import detect


def start(stream: DataFrame, rules: DataFrame, sink: str, checkpoint: str, resolver: Resolver | None = None, once: bool = False) -> StreamingQuery:
    """Writes the matches of the streamed documents (doc_id, text) as Parquet below ``sink``, one folder for each batch, so that a
    batch that runs again overwrites its own."""

    def batch(docs: DataFrame, number: int) -> None:
        detect.matches(docs.select("doc_id", "text"), rules, resolver).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
