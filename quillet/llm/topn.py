"""The N best items of every group, by descending score bands.

Every task first keeps the n best distinct items of each list that it reads: no other item
of the list can be among the n best of its group. What is left is range-partitioned by
score bands once. The bands are worked off from the top: they are ranked with exact ties,
groups that are full take no part in the next ones, and the last band ends the rest. In a
band rows are limited before they are shuffled by group, so a group of millions of items
never meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import cut, slices

#: Scales whose borders are broadcast; with more they are joined.
SMALL = 10_000
#: The top band holds this many times the items that all groups together need.
AMPLE = 2


def _borders(items: DataFrame, keys: list[str], score: str, n: int, scale: str | None) -> tuple[DataFrame | None, int]:
    """For each scale the lower borders of the bands but the last, ``_q``, from the top; and the number of bands.

    The first band has AMPLE times what the groups need, and the second half of the rest.
    Where the first would hold all items, it is the only one.
    """
    row = items.agg(F.count("*").alias("m"), F.approx_count_distinct(F.struct(*keys)).alias("g")).first()
    top = min(1.0, AMPLE * n * row["g"] / max(row["m"], 1))
    if top == 1.0:
        return None, 1
    by = [F.col(scale).alias("_scale")] if scale else [F.lit(0).alias("_scale")]
    made = cut(items.groupBy(*by).agg(F.percentile_approx(score, [1 - top, (1 - top) / 2], 1000).alias("_q")))
    return (F.broadcast(made) if made.limit(SMALL + 1).count() <= SMALL else made), 3


def _worked_off(items: DataFrame, keys: list[str], item: str, score: str, n: int, scale: str | None) -> DataFrame:
    items = cut(items.select(*keys, item, score))
    borders, bands = _borders(items, keys, score, n, scale)
    if borders is None:
        banded = items.withColumn("_band", F.lit(0))
    else:
        same = F.col(scale).eqNullSafe(F.col("_scale")) if scale else F.lit(0) == F.col("_scale")
        placed = items.join(borders, same).withColumn("_band", F.size(F.filter("_q", lambda q: F.col(score) < q)))
        spread = placed.repartitionByRange(slices(items.sparkSession), F.col("_band").asc(), F.col(score).desc(), F.xxhash64(item))
        banded = cut(spread.select(*items.columns, "_band"))
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item).asc())
    kept: DataFrame | None = None
    for band in range(bands):
        now = banded.filter(F.col("_band") == band).select(*keys, item, score)
        if kept is not None:
            full = kept.filter(F.col("place") == n).select(*(F.col(k).alias(f"_f_{k}") for k in keys))
            now = now.join(full, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys]), "left_anti")
            # Full groups stay as they are; the others take what they have into this band.
            now = kept.drop("place").unionByName(now)
        now = now.groupBy(*keys, item).agg(F.max(score).alias(score))
        kept = cut(now.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n))
    return kept


def _usable(score: Column, item: Column) -> Column:
    return score.isNotNull() & item.isNotNull() & ~F.isnan(score)


def top_n(items: DataFrame, keys: list[str], item: str, score: str, n: int, scale: str | None = None) -> DataFrame:
    """Rows (``keys``, ``item``, ``score``, ``place``) of the n best items of each group.

    Best is the highest score, then the smaller item; places count from 1. A repeated item
    has its highest score. Groups with fewer than n items keep all; null and NaN scores and
    null items do not exist. Null keys form a group. ``scale`` names a column whose values
    have scores of their own range; bands are then cut for each. An empty table gives no rows.
    """
    rows = items.select(*keys, item, score).filter(_usable(F.col(score), F.col(item)))
    return _worked_off(rows, keys, item, score, n, scale)


def top_n_of_runs(runs: DataFrame, keys: list[str], n: int, scale: str = "run_id") -> DataFrame:
    """top_n of nested rankings: (``keys``, ``doc_id``, ``score``, ``place``); items are read as in run_items.

    The lists are cut to their own n best distinct items where they are read.
    """
    usable = F.filter("ranked", lambda x: _usable(x["score"], x["doc_id"]))
    lists = runs.select(*keys, F.array_sort(F.transform(usable, lambda x: F.struct((-x["score"]).alias("minus"), x["doc_id"].alias("doc_id")))).alias("_l"))
    lists = lists.withColumn("_top", F.slice(F.array_distinct(F.transform("_l", lambda x: x["doc_id"])), 1, n))
    items = lists.select(*keys, F.explode(F.filter("_l", lambda x: F.array_contains(F.col("_top"), x["doc_id"]))).alias("_i"))
    return _worked_off(items.select(*keys, F.col("_i.doc_id").alias("doc_id"), (-F.col("_i.minus")).alias("score")), keys, "doc_id", "score", n, scale)


def wrong_cuts(runs: DataFrame, predictions: DataFrame, n: int = 5) -> DataFrame:
    """Rows (``run_id``, ``qid``, ``place``, ``doc_id``): the right cut of each group whose recorded one is wrong.

    The recorded cut is the row with the latest ``saved_at`` (null is the earliest; among
    equal times the greatest list). It is wrong when it is missing, null or not exactly the
    n best documents in order. Groups without any usable item are no cases.
    """
    keys = ["run_id", "qid"]
    best = top_n_of_runs(runs, keys, n)
    right = best.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("best")
    )
    saved = predictions.groupBy(*keys).agg(F.max(F.struct("saved_at", "predicted"))["predicted"].alias("predicted"))
    return (
        right.join(saved, keys, "left")
        .filter(~F.col("best").eqNullSafe(F.col("predicted")))
        .select(*keys, F.posexplode("best").alias("place", "doc_id"))
        .select(*keys, (F.col("place") + 1).cast("int").alias("place"), "doc_id")
    )
