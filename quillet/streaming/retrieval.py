"""Streams: questions that arrive are ranked against a standing index; events are counted by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillet.operators.retrieval import bm25_search


def rank_stream(questions: DataFrame, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, top_k: int = 10) -> StreamingQuery:
    """Each micro-batch of (``qid``, ``text``) is ranked against a token index by BM25 and handed to ``sink`` with its number."""

    def handle(batch: DataFrame, number: int) -> None:
        sink(bm25_search(index, batch, top_k=top_k).drop("k1", "b"), number)

    return questions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(``start``, ``by``, ``n``, ``total``) per tumbling window; events later than ``late`` are left out of streams."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    return watched.groupBy(F.window(time, size).alias("_w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("_w.start").alias("start"), by, "n", "total"
    )
