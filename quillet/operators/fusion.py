"""Fusion of runs and reranking. Runs are long: (qid, doc_id, score, rank), with ``run_id`` where a question has several lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.sources.rankings import ranked


def _rounded(score: Column, digits: int | None) -> Column:
    """Scores as they are, or rounded before they are compared, for those who want near scores to tie."""
    return score if digits is None else F.round(score, digits)


def _stacked(runs: list[DataFrame], weights: list[float] | None) -> DataFrame:
    weights = [1.0] * len(runs) if weights is None else list(weights)
    if len(weights) != len(runs):
        raise ValueError("runs and weights differ in number")
    parts = [
        r.select(
            "qid", "doc_id", "score", "rank", F.lit(i).alias("run"), F.lit(float(w)).alias("w"),
            (F.col("run_id") if "run_id" in r.columns else F.lit("")).alias("list"),
        )
        for i, (r, w) in enumerate(zip(runs, weights))
    ]
    return reduce(DataFrame.unionByName, parts)


def rrf(runs: list[DataFrame], weights: list[float] | None = None, K: int = 60, top_k: int = 100, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of w / (K + rank) by stored rank, over every list of the question."""
    fused = _stacked(runs, weights).groupBy("qid", "doc_id").agg(_rounded(F.sum(F.col("w") / (K + F.col("rank"))), digits).alias("score"))
    return ranked(fused, ["qid"], top_k)


def normalized(score: str, by: list[str], method: str) -> Column:
    """A score on the scale of its query; equal scores give 1 (minmax) or 0 (zscore)."""
    over = Window.partitionBy(*by)
    s = F.col(score)
    if method == "minmax":
        low, high = F.min(s).over(over), F.max(s).over(over)
        return F.when(high - low <= 1e-12, 1.0).otherwise((s - low) / (high - low))
    if method == "zscore":
        sd = F.stddev_pop(s).over(over)
        return F.when(sd <= 1e-12, 0.0).otherwise((s - F.avg(s).over(over)) / sd)
    if method == "sum":
        total = F.sum(F.abs(s)).over(over)
        return s / F.when(total == 0, 1.0).otherwise(total)
    raise ValueError(f"method must be minmax, zscore or sum, not {method!r}")


def weighted(
    runs: list[DataFrame], weights: list[float], method: str = "minmax", top_k: int = 100, missing: float = 0.0, digits: int | None = None
) -> DataFrame:
    """Weighted sum of normalised scores; a run that lacks a document adds ``missing`` by its weight.

    Each list of a run is normalised by itself and has the whole weight of the run.
    """
    scaled = _stacked(runs, weights).withColumn("s", normalized("score", ["run", "list", "qid"], method))
    held = scaled.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum("w").alias("held"))
    fill = F.lit(0.0)
    if missing:
        lists = scaled.select("qid", "run", "list", "w").distinct().groupBy("qid", "run").agg((F.sum("w") - F.max("w")).alias("more"))
        held = held.join(lists.groupBy("qid").agg(F.sum("more").alias("more")), "qid")
        fill = missing * (sum(weights) + F.col("more") - F.col("held"))
    return ranked(held.select("qid", "doc_id", _rounded(F.col("s") + fill, digits).alias("score")), ["qid"], top_k)


def sweep_weights(one: DataFrame, other: DataFrame, grid: list[float], top_k: int = 100, method: str = "minmax", digits: int | None = None) -> DataFrame:
    """All fusions w · one + (1 - w) · other in one job: (``w``, ``qid``, ``doc_id``, ``score``, ``rank``)."""
    scaled = _stacked([one, other], None).withColumn("s", normalized("score", ["run", "qid"], method))
    both = scaled.groupBy("qid", "doc_id").agg(
        F.sum(F.when(F.col("run") == 0, F.col("s")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("run") == 1, F.col("s")).otherwise(0.0)).alias("b"),
    )
    cells = both.select("*", F.explode(F.array(*(F.lit(float(w)) for w in grid))).alias("w"))
    fused = cells.select("w", "qid", "doc_id", _rounded(F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"), digits).alias("score"))
    return ranked(fused, ["w", "qid"], top_k)


def rerank(run: DataFrame, scores: DataFrame, depth: int = 50, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first ``depth`` by new scores (``qid``, ``doc_id``, ``new``), the others below in their order.

    ``keys`` name a ranking; those that ``scores`` has too join it.

    A document of the head without a new score has 0. The tail lies under the least head
    score by a millionth per place, so recall at full depth does not change.
    """
    head = run.filter(F.col("rank") <= depth).join(scores, [*(k for k in keys if k in scores.columns), "doc_id"], "left")
    head = head.select(*keys, "doc_id", F.coalesce("new", F.lit(0.0)).alias("score"))
    floor = head.groupBy(*keys).agg(F.min("score").alias("floor"))
    tail = run.filter(F.col("rank") > depth).join(floor, list(keys), "left")
    tail = tail.select(*keys, "doc_id", (F.coalesce("floor", F.lit(0.0)) - (F.col("rank") - depth) * 1e-6).alias("score"))
    return ranked(head.unionByName(tail).withColumn("score", F.round("score", 7)), list(keys))


def ceiling_table(recalls: DataFrame) -> DataFrame:
    """(``k``, ``recall``) with ``gain`` over the next smaller k."""
    return recalls.withColumn("gain", F.round(F.col("recall") - F.lag("recall", 1, 0.0).over(Window.orderBy("k")), 6))


def ceiling_gaps(base: DataFrame, reranked: DataFrame) -> DataFrame:
    """Reranked runs against what they could reach: (``run``, ``depth``, ``ceiling``, ``achieved``, ``gap``, ``percent``).

    ``base`` has (``k``, ``recall``) of the run that was reranked, ``reranked`` (``run``,
    ``recall``); the depth of a run stands at the end of its name, as in ``-d50``, and is the
    largest k of the base where it does not.
    """
    most = base.agg(F.max("k").alias("_most"))
    named = F.try_to_number(F.nullif(F.regexp_extract("run", r"-d(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int")
    rows = reranked.crossJoin(F.broadcast(most)).select("run", F.coalesce(named, "_most").alias("depth"), F.col("recall").alias("achieved"))  # one row
    made = rows.join(base.select(F.col("k").alias("depth"), F.col("recall").alias("ceiling")), "depth", "left")
    return made.select(
        "run", "depth", "ceiling", "achieved", F.round(F.col("ceiling") - F.col("achieved"), 6).alias("gap"),
        F.round(100 * F.try_divide("achieved", "ceiling"), 4).alias("percent"),
    )


def ceiling_verdict(ceiling: Column, achieved: Column) -> Column:
    """Which stage to work on, by the recall that a reranker could reach and does reach."""
    return (
        F.when(ceiling < 0.80, "RETRIEVER").when(ceiling - achieved > 0.10, "RERANKER").otherwise("RETRIEVER/stop")
    )
