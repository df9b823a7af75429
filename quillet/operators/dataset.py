"""Splits, profiles and training rows of data sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import running_sums


def percentiles(df: DataFrame, value: str, at: dict[str, float], aggregates: list[Column]) -> DataFrame:
    """One row of ``aggregates`` and order statistics: the item min(int(p·n), n - 1), from 0, of the sorted values.

    Values are counted first and the counts summed up over range partitions, so neither the
    rows nor the distinct values meet in one task.
    """
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    line = running_sums(counts, [], [F.col("_v").asc()], {"_upto": "_c"})
    total = rows.agg(F.count("*").alias("_n"))
    place = lambda p: F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1)
    picked = line.crossJoin(F.broadcast(total)).agg(*(F.min(F.when(F.col("_upto") > place(p), F.col("_v"))).alias(n) for n, p in at.items()))  # total is one row
    return rows.agg(*aggregates).crossJoin(F.broadcast(picked))  # one row each


def describe(df: DataFrame, value: str) -> DataFrame:
    return percentiles(
        df, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99},
        [F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")],
    )


def gold_histogram(gold: DataFrame, questions: DataFrame) -> DataFrame:
    """(``n_gold``, ``n``, ``share``, ``cumulative``) over all questions."""
    sizes = gold.groupBy("qid").agg(F.count("*").alias("g"))
    counts = questions.select("qid").distinct().join(sizes, "qid", "left").groupBy(F.coalesce("g", F.lit(0)).alias("n_gold")).agg(F.count("*").alias("n"))
    everything, upto = Window.partitionBy(), Window.orderBy("n_gold").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(everything)
    return counts.select("n_gold", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(F.sum("n").over(upto) / total, 6).alias("cumulative"))


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """(``key``, ``stratum``, ``split``): of each stratum max(1, round(n · fraction)) to dev, none of a single one.

    Rounds half to even. The order within a stratum is that of the digests of seed and key,
    so the split depends on neither partitions nor other strata. Rows are numbered over
    range partitions: a stratum of nearly all rows is spread like any other. A null stratum
    is one of its own.
    """
    rows = df.select(key, stratum).distinct().withColumn("_one", F.lit(1))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    n = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("int"))).otherwise(0)
    placed = running_sums(rows, [stratum], [order.asc(), F.col(key).asc()], {"_r": "_one"})
    sizes = F.broadcast(sizes.withColumnRenamed(stratum, "_s")) if sizes.limit(10_001).count() <= 10_000 else sizes.withColumnRenamed(stratum, "_s")
    return placed.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).select(key, stratum, F.when(F.col("_r") <= n, "dev").otherwise("train").alias("split"))


def split_report(split: DataFrame, stratum: str) -> DataFrame:
    return split.groupBy(stratum).agg(
        F.count("*").alias("n_all"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "dev").alias("n_dev"),
        F.round(100 * F.avg((F.col("split") == "dev").cast("int")), 6).alias("dev_percent"),
    )


def hard_negatives(
    run: DataFrame, gold: DataFrame, corpus: DataFrame, n: int = 8, skip_top: int = 2, depth: int = 50, margin: float | None = None, choose: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(``qid``, ``positive_id``, ``negative_ids``): for each gold document in the corpus the first n mistakes of the run.

    Candidates rank in (skip_top, depth], are not gold and, with ``margin``, score at most
    the best gold score within the depth less the margin. ``choose`` may order or thin the
    candidates: a function of their array of (rank, doc_id, score), by rank, at most
    ``depth`` long, whose first n are taken.
    """
    window = run.filter(F.col("rank") <= depth).join(gold.withColumn("_gold", F.lit(1)), ["qid", "doc_id"], "left")
    window = window.withColumn("_top", F.max(F.when(F.col("_gold") == 1, F.col("score"))).over(Window.partitionBy("qid")))
    keep = F.col("_gold").isNull() & (F.col("rank") > skip_top)
    if margin is not None:
        keep &= F.col("_top").isNull() | (F.col("score") <= F.col("_top") - margin)
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    picked = window.filter(keep).groupBy("qid").agg(items.alias("_l"))
    chosen = picked.select("qid", F.slice(F.transform(choose(F.col("_l")) if choose else F.col("_l"), lambda x: x["doc_id"]), 1, n).alias("negative_ids"))
    known = gold.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")
    return known.select("qid", F.col("doc_id").alias("positive_id")).join(chosen, "qid")


def positive_pairs(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    return gold.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").select("qid", F.col("doc_id").alias("positive_id"))


def exact_negatives(mined: DataFrame, n: int) -> DataFrame:
    """Mined rows that have n negatives, cut to exactly n."""
    return mined.filter(F.size("negative_ids") >= n).withColumn("negative_ids", F.slice("negative_ids", 1, n))


def cross_encoder_pairs(
    run: DataFrame, gold: DataFrame, corpus: DataFrame, per_positive: int = 4, skip_top: int = 2, depth: int = 50, seed: int = 42
) -> DataFrame:
    """(``qid``, ``doc_id``, ``label``): gold with 1, and per question min(per_positive · gold, candidates) mistakes with 0."""
    ids = corpus.select("doc_id").distinct()
    sizes = gold.groupBy("qid").agg(F.count("*").alias("_g"))
    candidates = (
        run.filter((F.col("rank") > skip_top) & (F.col("rank") <= depth)).join(gold, ["qid", "doc_id"], "left_anti").join(ids, "doc_id", "left_semi").join(sizes, "qid")
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "qid", "doc_id").cast("binary"))
    drawn = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(order, "doc_id"))).filter(F.col("_r") <= per_positive * F.col("_g"))
    positives = gold.join(ids, "doc_id", "left_semi").select("qid", "doc_id", F.lit(1).alias("label"))
    return positives.unionByName(drawn.select("qid", "doc_id", F.lit(0).alias("label")))


def masked_rows(df: DataFrame, prompt: str, answer: str, max_length: int) -> DataFrame:
    """Adds ``input_ids`` and ``labels`` of token-id arrays: the prompt masked by -100, both cut at max_length."""
    ids = F.slice(F.concat(prompt, answer), 1, max_length)
    labels = F.slice(F.concat(F.transform(prompt, lambda _: F.lit(-100)), F.col(answer)), 1, max_length)
    return df.withColumn("input_ids", ids).withColumn("labels", labels)
