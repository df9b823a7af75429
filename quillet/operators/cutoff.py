"""Cuts of rankings: variable-length top k under a hard cap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More documents than this score nothing.
CAP = 5
RULES = ("top_k", "ratio", "threshold", "gap")


def _joined(one: DataFrame, other: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """An inner join in which a null key meets itself."""
    named = other.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return one.join(named, same).drop(*(f"_k_{k}" for k in keys))


def heads(run: DataFrame, keys: tuple[str, ...], max_k: int, levels: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per ranking: ``_d`` its first max_k distinct documents, ``_s`` its first max_k + 1 scores, ``_n``, ``_top``
    and for each of ``levels``, (rule, value), how many scores reach it.

    Rows are limited before they are shuffled and counts are summed before, so a ranking of
    any length never meets in one row or task.
    """
    items = run.select(*keys, "doc_id", "score", "rank")
    order = [F.col("score").desc(), F.col("rank").asc(), F.col("doc_id").asc()]
    place = lambda over: F.row_number().over(Window.partitionBy(*over).orderBy(*order))
    firsts = items.groupBy(*keys, "doc_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "rank")).alias("_f"))
    firsts = firsts.select(*keys, "doc_id", (-F.col("_f.minus")).alias("score"), F.col("_f.rank").alias("rank"))
    firsts = firsts.withColumn("_p", place(keys)).filter(F.col("_p") <= max_k)
    docs = firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "doc_id"))), lambda x: x["doc_id"]).alias("_d"))
    best = items.withColumn("_p", place(keys)).filter(F.col("_p") <= max_k + 1)
    scores = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "score"))), lambda x: x["score"]).alias("_s"))
    out = _joined(docs, scores, keys)
    tops = items.groupBy(*keys).agg(F.max("score").alias("_top"), F.count("*").alias("_n"))
    if levels:
        reach = {n: F.col("score") >= (value * F.col("_top") if rule == "ratio" else F.lit(value)) for n, (rule, value) in levels.items()}
        counts = _joined(items, tops, keys).groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in reach.items()))
        tops = _joined(tops, counts, keys)
    return _joined(out, tops, keys)


def keep_count(rule: str, value: float | None, reached: Column | None = None, max_k: int = CAP, k: int = 10) -> Column:
    """How many documents a rule keeps of a row of heads, before the limits."""
    if rule == "top_k":
        return F.lit(int(k if value is None else value))
    if rule == "ratio":
        return F.when(F.col("_top") <= 0, F.lit(k)).otherwise(reached)
    if rule == "threshold":
        return reached
    if rule == "gap":
        last = F.least(F.col("_n").cast("int"), F.lit(max_k)) - 1
        drops = F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: (F.element_at("_s", i) - F.try_element_at("_s", i + 1)) / F.greatest(F.abs(F.col("_top")), F.lit(1e-9)),
        )
        return F.when(last < 1, F.col("_n").cast("int")).otherwise(F.array_position(drops, F.array_max(drops)).cast("int"))
    raise ValueError(f"rule must be one of {RULES}, not {rule!r}")


def _level(rule: str, value: float | None) -> tuple[str, float] | None:
    if rule == "ratio":
        return rule, float(0.8 if value is None else value)
    return (rule, float(value or 0.0)) if rule == "threshold" else None


def apply_cutoff(
    run: DataFrame,
    rule: str | Callable[[Column, Column], Column] = "top_k",
    value: float | None = None,
    min_k: int = 1,
    max_k: int = CAP,
    keys: tuple[str, ...] = ("qid",),
) -> DataFrame:
    """(``keys``, ``predicted``) of a run (``keys``, ``doc_id``, ``score``, ``rank``).

    The run is sorted by falling score, ties by rank; the rule counts, then repeated
    documents are dropped, then the limits hold. A query without items has no row. ``rule``
    may be a function of the arrays of documents and scores; it alone needs each ranking as
    one row, which the caller must know to be short.
    """
    if max_k > CAP:
        raise ValueError(f"more than {CAP} documents score nothing")
    if callable(rule):
        items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "rank", "doc_id")))
        lists = run.groupBy(*keys).agg(items.alias("_l")).select(*keys, F.transform("_l", lambda x: x["doc_id"]).alias("_a"), F.transform("_l", lambda x: -x["minus"]).alias("_s"))
        lists, keep = lists.withColumn("_d", F.array_distinct("_a")), rule(F.col("_a"), F.col("_s"))
    else:
        if rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
        level = _level(rule, value)
        lists = heads(run, keys, max_k, {"_reached": level} if level else {})
        keep = keep_count(rule, value, F.col("_reached") if level else None, max_k)
    n = F.greatest(F.lit(min_k), F.least(keep.cast("int"), F.lit(max_k), F.size("_d")))
    return lists.select(*keys, F.slice("_d", 1, n).alias("predicted"))


def sweep(run: DataFrame, settings: list[tuple[str, float | None]]) -> DataFrame:
    """(``rule``, ``value``, ``qid``, ``predicted``) of all settings from one row per query."""
    levels = {f"_r{i}": level for i, (rule, value) in enumerate(settings) if (level := _level(rule, value))}
    lists = heads(run, ("qid",), CAP, levels)
    each = []
    for i, (rule, value) in enumerate(settings):
        keep = keep_count(rule, value, F.col(f"_r{i}") if f"_r{i}" in levels else None).cast("int")
        each.append(
            F.struct(
                F.lit(rule).alias("rule"), F.lit(float(value or 0.0)).alias("value"),
                F.slice("_d", 1, F.greatest(F.lit(1), F.least(keep, F.lit(CAP), F.size("_d")))).alias("predicted"),
            )
        )
    return lists.select("qid", F.inline(F.array(*each))).select("rule", "value", "qid", "predicted")
