"""Whole pipelines of the operators: retrieval to score, hybrid retrieval, ablation, data reports."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import word_count
from quillet.operators import chunk, cutoff, dataset, fusion, metrics, qa, retrieval, textgen
from quillet.operators.analysis import duplicate_passages, unreachable
from quillet.session import cut
from quillet.sources.rankings import qrels


def set_seed(seed: int) -> int:
    """Seed the driver's generators; the operators take seeds as values of their plans."""
    import numpy

    random.seed(seed)
    numpy.random.seed(seed)
    return seed


def unlabelled(queries: DataFrame) -> bool:
    """Whether no question has gold: then a run is made, and no scores."""
    return qrels(queries, parent=False).isEmpty()


def retrieve_and_score(
    corpus: DataFrame, queries: DataFrame, granularity: str = "document", k1: float = 1.2, b: float = 0.75, depth: int = 100,
    aggregate: str = "max", rule: str = "top_k", value: float | None = 5, digits: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Chunk, index, rank, collapse to documents after the cut at ``depth``, cut, score: (run, predictions, scores).

    ``corpus`` has (``doc_id``, ``text``, ``title``), ``queries`` (``qid``, ``text``, ``relevant``).
    Scores are None for an unlabelled set.
    """
    parts = cut(chunk.build_corpus(corpus, granularity))
    run = retrieval.bm25(parts, queries, k1, b, depth, digits)
    if granularity != "document":
        run = chunk.aggregate_to_parent(run, parts, aggregate, depth)
    run = cut(run)
    predictions = cutoff.apply_cutoff(run, rule, value)
    if unlabelled(queries):
        return run, predictions, None
    gold = qrels(queries)
    return run, predictions, metrics.set_scores(metrics.question_scores(queries, gold, predictions))


def grid_search(index: DataFrame, queries: DataFrame, k1s: list[float], bs: list[float], by: str = "recall_10") -> DataFrame:
    """All settings of BM25 with their rank metrics, the best by ``by``, then by precision, first.

    ``official`` stands for recall_5, the recall of the first five documents, which the cap lets through.
    """
    by = "recall_5" if by == "official" else by
    made = retrieval.bm25_search(index, queries, [(k1, b) for k1 in k1s for b in bs])
    scored = metrics.rank_metrics(queries, qrels(queries), made, by=("k1", "b"))
    return scored.orderBy(F.col(by).desc(), F.col("precision_5").desc(), "k1", "b")


def hybrid(
    dense: DataFrame, lexical: DataFrame, queries: DataFrame, method: str = "rrf", weights: tuple[float, ...] = (0.2, 0.4, 0.5, 0.6, 0.8), top_k: int = 100, digits: int | None = None
) -> DataFrame:
    """(``w_dense``, rank metrics) of the fusions; a best weight at an end says that one run adds nothing."""
    gold = qrels(queries)
    if method == "rrf":
        parts = [fusion.rrf([dense, lexical], [w, 1 - w], top_k=top_k, digits=digits).withColumn("w", F.lit(float(w))) for w in weights]
        made = reduce(DataFrame.unionByName, parts)
    else:
        made = fusion.sweep_weights(dense, lexical, list(weights), top_k, method, digits)
    return metrics.rank_metrics(queries, gold, made, (10, top_k), by=("w",)).withColumnRenamed("w", "w_dense").orderBy(F.col(f"recall_{top_k}").desc(), "w_dense")


def ablation(
    questions: DataFrame, gold: DataFrame, run: DataFrame, corpus: DataFrame, model: Callable[[list[str]], list[str]], variants: list[str], ks: list[int]
) -> DataFrame:
    """(``variant``, ``k``, ``rouge_l``, ``meteor``) of each prompt and number of passages, the best METEOR first."""
    parts = []
    for k in ks:
        made = qa.contexts(run, corpus, k)
        for variant in variants:
            answers = qa.generate(qa.prompts(questions, made, variant), model)
            parts.append(textgen.eval_qa(gold, answers).select(F.lit(variant).alias("variant"), F.lit(k).alias("k"), "rouge_l", "meteor"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("meteor").desc(), "variant", "k")


def chunk_report(corpus: DataFrame) -> dict:
    """Statistics of a chunked corpus with warnings for long parts and for a corpus that did not split."""
    row = chunk.corpus_stats(corpus).first().asDict()
    row["chunks_per_document"] = round(row["n_chunks"] / max(row["n_parents"], 1), 2)
    row["warnings"] = [
        *(["the longest tenth of the parts exceeds 180 words"] if (row["len_p90"] or 0) > 180 else []),
        *(["no document was split"] if row["n_chunks"] == row["n_parents"] and row["n_chunks"] else []),
    ]
    return row


def pair_count(queries: DataFrame, parts: DataFrame) -> int:
    """Pairs that a full comparison of questions and parts would score."""
    return queries.count() * parts.count()


def data_facts(corpus: DataFrame, queries: DataFrame, other: DataFrame, limits: tuple[int, ...] = (256, 512, 1024, 2048, 4096, 8192)) -> DataFrame:
    """(``fact``, ``value``) of a data set: sizes, gold coverage, lengths over limits, overlap with another set, landmines."""
    gold = qrels(queries)
    n = word_count(F.col("text"))
    lengths = corpus.agg(F.count("*").alias("documents"), F.sum(n).alias("words"), *(F.count_if(n > k).alias(f"over_{k}") for k in limits))
    twins = duplicate_passages(corpus)
    facts = [
        lengths.select(F.inline(F.array(*(F.struct(F.lit(c).alias("fact"), F.col(c).cast("double").alias("value")) for c in lengths.columns)))),
        *(
            df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("fact"), "value")
            for name, df in (
                ("questions", queries.select("qid").distinct()), ("gold_documents", gold.select("doc_id").distinct()),
                ("gold_documents_in_corpus", gold.select("doc_id").distinct().join(corpus, "doc_id", "left_semi")),
                ("questions_shared", queries.select("text").intersect(other.select("text"))), ("unreachable_questions", unreachable(gold, corpus)),
                ("duplicate_passage_groups", twins), ("questions_whose_gold_has_a_twin", _twinned(gold, corpus, twins)),
            )
        ),
    ]
    return reduce(DataFrame.unionByName, facts)


def _twinned(gold: DataFrame, corpus: DataFrame, twins: DataFrame) -> DataFrame:
    from quillet.functions.text import fingerprint

    own = corpus.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")).join(twins, "fingerprint", "left_semi")
    return gold.join(own, "doc_id", "left_semi").select("qid").distinct()


def cutoff_report(swept: DataFrame) -> str:
    """A Markdown table of (``rule``, ``value``, ``recall``, ``precision``), the best recall, then precision, first."""
    rows = swept.orderBy(F.col("recall").desc(), F.col("precision").desc(), "rule", "value").collect()  # one row per setting
    return "\n".join(["| rule | value | recall | precision |", "|---|---|---|---|", *(f"| {r['rule']} | {r['value']:g} | {r['recall']:.4f} | {r['precision']:.4f} |" for r in rows)])


def training_rows(run: DataFrame, queries: DataFrame, corpus: DataFrame, n: int = 8) -> DataFrame:
    """(``qid``, ``query``, ``positive_id``, ``positive``, ``negative_ids``, ``negatives``), texts in the order of the ids."""
    mined = dataset.hard_negatives(run, qrels(queries), corpus, n).join(queries.select("qid", F.col("text").alias("query")), "qid")
    texts = corpus.select("doc_id", "text")
    each = mined.select("qid", "positive_id", F.posexplode("negative_ids").alias("pos", "doc_id")).join(texts, "doc_id", "left")
    items = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t"))))
    negatives = each.groupBy("qid", "positive_id").agg(F.transform(items, lambda x: x["t"]).alias("negatives"))
    positives = texts.select(F.col("doc_id").alias("positive_id"), F.coalesce("text", F.lit("")).alias("positive"))
    return mined.join(positives, "positive_id").join(negatives, ["qid", "positive_id"]).select("qid", "query", "positive_id", "positive", "negative_ids", "negatives")
