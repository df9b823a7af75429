"""Where each point of recall is lost, per question and together, and checks of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import fingerprint
from quillet.operators.cutoff import CAP

LOSSES = ("loss_cap", "loss_retrieval", "loss_ranking", "loss_cutoff", "loss_zeroed")


def diagnose(questions: DataFrame, gold: DataFrame, run: DataFrame, predictions: DataFrame, corpus: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """One row per question; recall and the five losses sum to 1 where there is gold.

    A document's rank is its first in the run. Each ceiling is at least what was achieved,
    so no loss is negative even where a prediction is no prefix of its run; ``prefix_violation``
    says so. With ``corpus`` (``doc_id``) unknown ids are counted, else they are 0.
    """
    g = gold.select("qid", "doc_id").distinct()
    first = run.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    found = g.join(first, ["qid", "doc_id"], "left")
    known = corpus.select("doc_id").distinct().withColumn("_known", F.lit(1)) if corpus is not None else None
    found = found.join(known, "doc_id", "left") if known is not None else found.withColumn("_known", F.lit(1))
    per_gold = found.groupBy("qid").agg(
        F.collect_set("doc_id").alias("gold"), F.count("*").alias("n_gold"), F.count("rank").alias("n_gold_retrieved"),
        F.count_if(F.col("rank") <= cap).alias("n_gold_in_cap"), F.min("rank").alias("best_gold_rank"), F.max("rank").alias("worst_gold_rank"),
        F.count_if(F.col("_known").isNull()).alias("n_gold_missing_corpus"),
    )
    shape = run.groupBy("qid").agg(
        F.count("*").alias("run_depth"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"), F.max_by("score", F.when(F.col("rank") <= cap, F.col("rank"))).alias("tail"),
    )
    pred = F.coalesce("predicted", F.array().cast("array<string>"))
    rel = F.coalesce("gold", F.array().cast("array<string>"))
    rows = questions.select("qid").distinct().join(per_gold, "qid", "left").join(shape, "qid", "left").join(predictions.select("qid", "predicted"), "qid", "left")
    if known is not None:
        unknown = predictions.select("qid", F.explode("predicted").alias("doc_id")).join(known, "doc_id", "left_anti")
        rows = rows.join(unknown.groupBy("qid").agg(F.count("*").alias("n_unknown")), "qid", "left")
    else:
        rows = rows.withColumn("n_unknown", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    G, R, T = zero("n_gold"), zero("n_gold_retrieved"), zero("n_gold_in_cap")
    n = F.size(pred)
    rows = rows.select(
        "qid", G.alias("n_gold"), n.alias("n_pred"), F.size(F.array_intersect(pred, rel)).alias("n_hit_raw"),
        F.when(n == 0, "zeroed_empty").when(n > cap, "zeroed_over_cap").otherwise("ok").alias("state"),
        R.alias("n_gold_retrieved"), T.alias("n_gold_in_cap"), "best_gold_rank", "worst_gold_rank", zero("run_depth").alias("run_depth"),
        F.size(F.filter(pred, lambda d: ~F.array_contains(rel, d))).alias("slots_wasted"),
        F.greatest(F.lit(0), cap - n).alias("slots_free"),
        (F.size(F.array_distinct(pred)) < n).alias("has_duplicates"),
        F.exists(pred, lambda d: d.contains("#") | d.contains("::")).alias("has_chunk_ids"),
        zero("n_unknown").alias("n_unknown"), zero("n_gold_missing_corpus").alias("n_gold_missing_corpus"),
        F.coalesce("top1", F.lit(0.0)).alias("top1_score"), F.coalesce("top2", F.lit(0.0)).alias("_top2"), F.coalesce("tail", F.lit(0.0)).alias("_tail"),
    )
    a = F.col("n_hit_raw")
    t = F.greatest(F.col("n_gold_in_cap"), a)
    r = F.greatest(F.least(F.col("n_gold_retrieved"), F.lit(cap)), t)
    c = F.greatest(F.least(F.col("n_gold"), F.lit(cap)), r)
    part = lambda x: F.round(F.coalesce(F.try_divide(x, F.col("n_gold")), F.lit(0.0)), 6)
    ok = F.col("state") == "ok"
    return rows.select(
        *[x for x in rows.columns if x[0] != "_"],
        part(F.when(ok, a).otherwise(0)).alias("recall"),
        F.round(F.when(ok, F.coalesce(F.try_divide(a, F.col("n_pred")), F.lit(0.0))).otherwise(0.0), 6).alias("precision"),
        part(F.col("n_gold") - c).alias("loss_cap"), part(c - r).alias("loss_retrieval"), part(r - t).alias("loss_ranking"),
        part(t - a).alias("loss_cutoff"), part(F.when(ok, 0).otherwise(a)).alias("loss_zeroed"),
        (a > F.col("n_gold_in_cap")).alias("prefix_violation"), (F.col("n_gold") > cap).alias("impossible"),
        F.round(F.col("top1_score") - F.col("_top2"), 6).alias("score_margin"),
        F.round(F.when(F.col("top1_score") > 0, F.col("_top2") / F.col("top1_score")).otherwise(0.0), 6).alias("score_margin_ratio"),
        F.round(F.when(F.col("top1_score") > 0, F.col("_tail") / F.col("top1_score")).otherwise(0.0), 6).alias("score_tail_ratio"),
    )


def aggregate(diagnosed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means and counts of diagnoses, together or per group."""
    return (diagnosed.groupBy(*by) if by else diagnosed.groupBy()).agg(
        F.count("*").alias("n_queries"),
        *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", *LOSSES)),
        F.round(F.avg("slots_free"), 6).alias("avg_slots_free"),
        F.count_if(F.col("recall") >= 1).alias("n_perfect"), F.count_if(F.col("recall") <= 0).alias("n_zero"),
        F.count_if(F.col("state") == "zeroed_over_cap").alias("n_zeroed_over_cap"), F.count_if(F.col("state") == "zeroed_empty").alias("n_zeroed_empty"),
        F.count_if("has_duplicates").alias("n_with_duplicates"), F.count_if("has_chunk_ids").alias("n_with_chunk_ids"),
        F.count_if("prefix_violation").alias("n_prefix_violation"), F.count_if(F.col("n_gold_missing_corpus") > 0).alias("n_gold_missing_corpus"),
    )


def verdict(row: dict) -> list[str]:
    """Statements on one aggregate: broken data first, then the losses from the largest."""
    checks = (
        ("n_gold_missing_corpus", "questions have gold that is not in the corpus: the ids disagree"),
        ("n_with_chunk_ids", "questions return ids of parts: aggregate them to documents"),
        ("n_zeroed_over_cap", "questions exceed the cap and score nothing: clamp the cut"),
        ("n_zeroed_empty", "questions return nothing and score nothing: keep at least one"),
        ("n_with_duplicates", "questions repeat an id: each repeat wastes a place"),
        ("n_prefix_violation", "predictions are no prefix of the run: losses are approximate"),
    )
    lines = [f"{row[k]} {what}" for k, what in checks if row[k]]
    gap = sum(row[k] for k in LOSSES)
    for k in sorted(LOSSES, key=lambda k: -row[k]):
        if row[k] > 1e-9:
            lines.append(f"{row[k]:.4f} of {gap:.4f} lost ({100 * row[k] / gap:.0f}%) by {k[5:]}")
    if row["avg_slots_free"] > 0.5 and row["loss_cutoff"] > 1e-9:
        lines.append(f"cheapest gain: {row['avg_slots_free']:.1f} places are free on average; sweep the cutoff")
    return lines


def rank_bucket(rank: Column) -> Column:
    made = F.when(rank.isNull(), "not retrieved").when(rank == 1, "1")
    for low, high in ((2, 5), (6, 10), (11, 25), (26, 50), (51, 100)):
        made = made.when(rank <= high, f"{low}-{high}")
    return made.otherwise(">100")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 10, "1-10").when(n <= 20, "11-20").when(n <= 40, "21-40").otherwise(">40")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per question the change from diagnosis a to b; a question that only one has counts as 0 in the other."""
    one = a.select("qid", *(F.col(c).alias(f"_{c}") for c in ("recall", *LOSSES)))
    both = one.join(b.select("qid", "recall", *LOSSES), "qid", "full")
    delta = lambda c: F.round(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"_{c}", F.lit(0.0)), 6)
    rows = both.select("qid", delta("recall").alias("d_recall"), *(delta(c).alias(f"d_{c}") for c in LOSSES))
    return rows.withColumn("change", F.when(F.col("d_recall") > 0, "improved").when(F.col("d_recall") < 0, "regressed").otherwise("same"))


def worst(diagnosed: DataFrame, n: int) -> DataFrame:
    """The n questions of least recall, then most lost by the cutoff, with their main loss."""
    main = F.array_max(F.array(*(F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(LOSSES))))
    rows = diagnosed.withColumn("dominant", F.when(main["v"] > 0, main["c"]))
    return rows.orderBy("recall", F.col("loss_cutoff").desc(), "qid").limit(n).select("qid", "recall", "dominant", *LOSSES)


def dangling_gold(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    return gold.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").select("qid", "doc_id")


def unreachable(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """Questions all of whose gold documents are blank or absent."""
    text = corpus.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") != "").select("doc_id").distinct().withColumn("_ok", F.lit(1))
    return gold.join(text, "doc_id", "left").groupBy("qid").agg(F.count("_ok").alias("n")).filter("n = 0").select("qid")


def quarantined(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """Questions that have gold documents, all of them in the corpus and blank; one that is absent does not count as blank."""
    full = F.max(F.when(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") != "", 1).otherwise(0))
    blank = corpus.groupBy("doc_id").agg(full.alias("_full")).filter("_full = 0").select("doc_id", F.lit(1).alias("_blank"))
    return gold.join(blank, "doc_id", "left").groupBy("qid").agg(F.count_if(F.col("_blank").isNull()).alias("n")).filter("n = 0").select("qid")


def duplicate_passages(corpus: DataFrame) -> DataFrame:
    """(``fingerprint``, ``n_docs``, ``first_doc``) of texts that several documents hold."""
    rows = corpus.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")).dropna().distinct()
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")
