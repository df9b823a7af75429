"""Set-based and rank-based metrics over relevance (qid, doc_id), runs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators.cutoff import CAP


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    return _ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def question_scores(questions: DataFrame, gold: DataFrame, predictions: DataFrame, cap: int = CAP) -> DataFrame:
    """Per question (``qid``, ``n_gold``, ``n_pred``, ``hit``, ``recall``, ``precision``).

    Every question counts: a missing prediction is empty, and an empty one or one above the
    cap scores nothing. Precision divides by the raw length, repeats included.
    """
    rel = gold.groupBy("qid").agg(F.collect_set("doc_id").alias("gold"))
    rows = questions.select("qid").distinct().join(rel, "qid", "left").join(predictions, "qid", "left")
    rel_, pred = F.coalesce("gold", F.array().cast("array<string>")), F.coalesce("predicted", F.array().cast("array<string>"))
    n = F.size(pred)
    hit = F.when((n > 0) & (n <= cap), F.size(F.array_intersect(pred, rel_))).otherwise(0)
    return rows.select("qid", F.size(rel_).alias("n_gold"), n.alias("n_pred"), hit.alias("hit")).withColumns(
        {"recall": _ratio(F.col("hit"), F.col("n_gold")), "precision": _ratio(F.col("hit"), F.col("n_pred"))}
    )


def set_scores(scores: DataFrame, by: list[str] | None = None, cap: int = CAP, beta: float = 1.0) -> DataFrame:
    """One row of micro and macro precision, recall and F, and counts; per group where ``by`` is given."""
    sums = (scores.groupBy(*by) if by else scores.groupBy()).agg(
        F.count("*").alias("n_queries"), F.sum("hit").alias("_h"), F.sum("n_pred").alias("_p"), F.sum("n_gold").alias("_g"),
        F.sum("recall").alias("_r"), F.sum("precision").alias("_q"),
        F.count_if(F.col("n_pred") > cap).alias("n_over_cap"), F.count_if(F.col("n_pred") == 0).alias("n_empty"),
    )
    n = F.greatest("n_queries", F.lit(1))
    micro_p, micro_r, macro_p, macro_r = _ratio(F.col("_h"), F.col("_p")), _ratio(F.col("_h"), F.col("_g")), F.col("_q") / n, F.col("_r") / n
    made = {
        "micro_precision": micro_p, "micro_recall": micro_r, "micro_f": f_beta(micro_p, micro_r, beta),
        "macro_precision": macro_p, "macro_recall": macro_r, "macro_f": f_beta(macro_p, macro_r, beta),
        "avg_pred": F.col("_p") / n, "avg_gold": F.col("_g") / n,
    }
    return sums.select(*(by or []), "n_queries", "n_over_cap", "n_empty", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(k) for k, c in made.items()))


def compare(a: tuple[float, float], b: tuple[float, float]) -> int:
    """Recall decides, then precision: 1, -1 or 0."""
    return (a > b) - (a < b)


def strict_scores(gold: DataFrame, predictions: DataFrame) -> tuple[float, float]:
    """The organiser's form: raises unless predictions and gold have the same questions."""
    extra = predictions.join(gold.select("qid").distinct(), "qid", "left_anti").isEmpty()
    missing = gold.select("qid").distinct().join(predictions, "qid", "left_anti").isEmpty()
    if not (extra and missing):
        raise ValueError("predictions and gold have different questions")
    row = set_scores(question_scores(gold, gold, predictions)).first()
    return row["macro_recall"], row["macro_precision"]


def submission_checks(questions: DataFrame, predictions: DataFrame, cap: int = CAP, by: tuple[str, ...] = ()) -> DataFrame:
    """(``problem``, ``qid``) of everything that would not be accepted, for each submission that ``by`` names."""
    asked = questions.select("qid").distinct()
    p = predictions.select(*by, "qid", "predicted")
    due = p.select(*by).distinct().crossJoin(asked) if by else asked
    kinds = {
        "missing": due.join(p, [*by, "qid"], "left_anti"),
        "extra": p.join(asked, "qid", "left_anti"),
        "over_cap": p.filter(F.size("predicted") > cap),
        "duplicates": p.filter(F.size(F.array_distinct("predicted")) < F.size("predicted")),
        "empty": p.filter(F.coalesce(F.size("predicted"), F.lit(0)) <= 0),
        "null_ids": p.filter(F.exists("predicted", lambda x: x.isNull())),
    }
    out = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("problem"), *by, "qid").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def rank_metrics(
    questions: DataFrame, gold: DataFrame, run: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 50, 100), by: tuple[str, ...] = ()
) -> DataFrame:
    """One row (per ``by``): recall@k and precision@k for each k, mrr@10, map@100, ndcg@10.

    Everything comes from one pass over the hits. All divide by the number of questions;
    questions without gold stay in it. Rank is the stored one.
    """
    n = max(questions.select("qid").distinct().count(), 1)
    sizes = gold.groupBy("qid").agg(F.count("*").alias("_g"))
    hits = run.join(gold, ["qid", "doc_id"]).join(sizes, "qid")
    running = Window.partitionBy(*by, "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_i", F.count("*").over(running))
    each = hits.groupBy(*by, "qid", "_g").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks),
        F.min("rank").alias("_first"),
        F.sum(F.when(F.col("rank") <= 100, F.col("_i") / F.col("rank")).otherwise(0.0)).alias("_ap"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_g"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    each = each.withColumn("_ideal", ideal)
    return each.groupBy(*by).agg(
        *(F.round(F.sum(F.col(f"h{k}") / F.col("_g")) / n, 6).alias(f"recall_{k}") for k in ks),
        *(F.round(F.sum(F.col(f"h{k}") / F.lit(k)) / n, 6).alias(f"precision_{k}") for k in ks),
        F.round(F.sum(F.when(F.col("_first") <= 10, 1 / F.col("_first")).otherwise(0.0)) / n, 6).alias("mrr_10"),
        F.round(F.sum(F.col("_ap") / F.least(F.col("_g"), F.lit(100))) / n, 6).alias("map_100"),
        F.round(F.sum(F.col("_dcg") / F.col("_ideal")) / n, 6).alias("ndcg_10"),
    )
