"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import bpe, defects, frequency, outranking, overlap, packing, splits, subjects, textform, topn

PAIRED_TEXTS = (("corpus_document", "doc_id", "text"), ("queries_train", "qid", "text"), ("task2_train", "qid", "answer"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _flows(spark: SparkSession, d: str) -> DataFrame:
    dev = table(spark, d, "queries_dev").select("qid").distinct()
    runs = table(spark, d, "runs").join(dev, "qid", "left_semi")
    return outranking.run_flows(runs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return outranking.combined_ranking(_flows(spark, d), "qid", "doc_id", top=1).select("qid", "doc_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return outranking.combined_ranking(_flows(spark, d), "qid", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        textform.look_alike_pairs(table(spark, d, t), key, column).select(F.lit(t).alias("tbl"), "key_a", "key_b")
        for t, key, column in PAIRED_TEXTS
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        textform.canonical_text(
            table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(key).alias("key"), F.col(column).alias("text")), "text"
        ).select("tbl", "key", F.col("canonical").alias("text"))
        for t, key, column in PAIRED_TEXTS
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _question_documents(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "queries_train").select("qid", F.explode("relevant").alias("id"))
    return named.select("qid", F.regexp_replace("id", "#.*$", "").alias("document"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    made = splits.groups(_question_documents(spark, d), "qid", "document")
    return made.select("qid", F.col("group").alias("group_qid"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    shares = {r["split_name"]: r["share"] for r in table(spark, d, "split_shares").collect()}
    made = splits.groups(_question_documents(spark, d), "qid", "document")
    return splits.assign_splits(table(spark, d, "queries_train"), "qid", made, shares)


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: records placed, groups that are torn, and splits whose size is off by more than a hundredth of all records."""
    made = p3_splits(spark, d)
    tied = splits.groups(_question_documents(spark, d), "qid", "document")
    torn = made.join(tied, "qid").groupBy("group").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    total = made.agg(F.count("*").alias("records"), F.count_distinct("qid").alias("qids"))
    sizes = made.groupBy("split").agg(F.count("*").alias("n"))
    shares = table(spark, d, "split_shares").select(F.col("split_name").alias("split"), "share")
    off = shares.join(sizes, "split", "full").crossJoin(F.broadcast(total)).agg(  # one row
        F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("share", F.lit(0.0)) * F.col("records")) > F.col("records") / 100 + 1).alias("off")
    )
    return total.crossJoin(F.broadcast(torn)).crossJoin(F.broadcast(off)).select("records", "qids", "torn", "off")  # one row each


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    made = frequency.marked_terms(table(spark, d, "corpus_document"), "doc_id", "text", "loaded_at")
    return made.filter("mark is not null").select("term", F.col("mark").alias("verdict"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(table(spark, d, "corpus_document"), "doc_id", "text", "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective_pairs(table(spark, d, "task2_train"), "qid", "text", "answer")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_records(table(spark, d, "queries_dev"), table(spark, d, "queries_train"), "qid", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(
        F.least("left_key", "right_key").alias("qid_a"), F.greatest("left_key", "right_key").alias("qid_b")
    )


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    dev, train = table(spark, d, "queries_dev"), table(spark, d, "queries_train")
    return overlap.overlap_report(_overlaps(spark, d), dev, train, "qid", "source", ("dev", "train"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.wrong_cuts(table(spark, d, "runs"), table(spark, d, "predictions"))


def p7_top5(spark: SparkSession, d: str) -> DataFrame:
    keys = ["run_id", "qid"]
    best = topn.top_n_of_runs(table(spark, d, "runs"), keys, 5)
    return best.select(*keys, "place", "doc_id", "score")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts packed, containers that overflow, short texts that are split, and texts of which a token is missing or twice."""
    made = p9_containers(spark, d).withColumn("n", F.col("end_token") - F.col("first_token"))
    loads = made.groupBy("container").agg(F.sum("n").alias("load")).agg(F.count_if(F.col("load") > 4096).alias("overfull"))
    counts = bpe.token_counts(table(spark, d, "documents"), "doc_id", "text").filter("tokens > 0")
    own = made.groupBy("doc_id").agg(
        F.count("*").alias("parts"), F.sum("n").alias("held"), F.min("first_token").alias("low"), F.max("end_token").alias("high"), F.count_distinct("first_token").alias("begins")
    )
    both = counts.join(own, "doc_id", "full")
    sound = (F.col("held") == F.col("tokens")) & (F.col("low") == 0) & (F.col("high") == F.col("tokens")) & (F.col("begins") == F.col("parts"))
    texts = both.agg(
        F.count("parts").alias("texts"), F.count_if((F.col("tokens") <= 4096) & (F.col("parts") > 1)).alias("split_short"),
        F.count_if(~F.coalesce(sound, F.lit(False))).alias("wrong_cover"),
    )
    return texts.crossJoin(F.broadcast(loads)).select("texts", "overfull", "split_short", "wrong_cover")  # one row each


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_labels"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return p10_found(spark, d).groupBy("subject").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_ranking, p2_found, p2_texts, p3_found, p3_splits, p3_checks, p4_found, p4_terms, p5_found,
            p6_found, p6_report, p7_found, p7_top5, p8_ids, p9_containers, p9_fill, p10_found, p10_composition,
        )
    }


def oracle_sql() -> dict[str, str]:
    from quillet.llm.sql import oracle_sql as made

    return made()
