"""Answering a stream of query vectors against a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.topk import exact_topk


def stream_topk(queries: DataFrame, base: DataFrame, k: int, out: str, checkpoint: str):
    """Start a query that appends the exact top-k of each micro-batch of (qid, qv) to ``out``.

    The batch number is part of the folder, so a batch that is repeated after
    a failure replaces its own rows.
    """

    def answer(batch: DataFrame, epoch: int) -> None:
        exact_topk(base, batch, k).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
