"""Runs, predictions and relevance between nested rows and long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_items(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Usable items of nested rankings: one row (``keys``, ``doc_id``, ``score``) per document.

    All slices are read together; a document's score is its highest. Items that are null or
    have a null id or a null or NaN score do not exist; null and empty lists have no items.
    """
    return (
        runs.select(*keys, F.explode("ranked").alias("_i"))
        .select(*keys, F.col("_i.doc_id").alias("doc_id"), F.col("_i.score").alias("score"))
        .filter("doc_id is not null and score is not null and not isnan(score)")
        .groupBy(*keys, "doc_id")
        .agg(F.max("score").alias("score"))
    )


def ranked(items: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """Items with ``rank`` from 1: by falling score, ties by the smaller document."""
    over = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc())
    made = items.withColumn("rank", F.row_number().over(over))
    return made if depth is None else made.filter(F.col("rank") <= depth)


def nest_run(run: DataFrame, keys: list[str]) -> DataFrame:
    """``ranked``, an array of (doc_id, score) in the order of ``rank``, per group."""
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    return run.groupBy(*keys).agg(
        F.transform(items, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("ranked")
    )


def unnest_run(nested: DataFrame, keys: list[str]) -> DataFrame:
    """The stored order of a nested run as ``rank``; list order is rank, not score order."""
    return nested.select(*keys, F.posexplode("ranked").alias("_p", "_i")).select(
        *keys, F.col("_i.doc_id").alias("doc_id"), F.col("_i.score").alias("score"), (F.col("_p") + 1).alias("rank")
    )


def nest_predictions(long: DataFrame, keys: list[str]) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("pos", "doc_id")))
    return long.groupBy(*keys).agg(F.transform(items, lambda x: x["doc_id"]).alias("predicted"))


def unnest_predictions(nested: DataFrame, keys: list[str]) -> DataFrame:
    return nested.select(*keys, F.posexplode("predicted").alias("_p", "doc_id")).select(
        *keys, "doc_id", (F.col("_p") + 1).alias("pos")
    )


def latest(df: DataFrame, keys: list[str], when: str) -> DataFrame:
    """One row per key: the one with the greatest ``when``, among equals the greatest row."""
    rest = [c for c in df.columns if c not in (*keys, when)]
    best = F.max(F.struct(when, *rest)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest), F.col(f"_b.{when}").alias(when))


def qrels(queries: DataFrame, parent: bool = True) -> DataFrame:
    """Distinct (``qid``, ``doc_id``); with ``parent`` an article stands for its document."""
    named = queries.select("qid", F.explode("relevant").alias("doc_id")).filter("doc_id is not null")
    if parent:
        named = named.withColumn("doc_id", F.regexp_replace("doc_id", "(#|::).*$", ""))
    return named.distinct()
