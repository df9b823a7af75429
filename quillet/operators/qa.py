"""Answers from retrieved text: contexts, prompts, ceilings, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import normalize, shorten, word_count

# The wording of the prompts.
SYSTEM = "Bạn là trợ lý pháp lý. Chỉ trả lời dựa trên các đoạn văn bản được cung cấp."
PROMPTS = {
    "minimal": "Các đoạn văn bản pháp luật:\n{context}\n\nCâu hỏi: {question}\nTrả lời:",
    "grounded": "Các đoạn văn bản pháp luật:\n{context}\n\nCâu hỏi: {question}\n\nChỉ sử dụng thông tin trong các đoạn văn bản trên. Không sử dụng kiến thức bên ngoài. Nếu các đoạn văn bản không chứa câu trả lời, hãy trả lời \"Không tìm thấy thông tin\".\nTrả lời:",
    "cited": "Các đoạn văn bản pháp luật:\n{context}\n\nCâu hỏi: {question}\n\nChỉ sử dụng thông tin trong các đoạn văn bản trên. Nêu rõ điều khoản làm căn cứ.\nTrả lời (kèm căn cứ):",
    "mimic": "Các đoạn văn bản pháp luật:\n{context}\n\nCâu hỏi: {question}\n\nChỉ sử dụng thông tin trong các đoạn văn bản trên. Trả lời theo đúng cấu trúc sau:\nBắt đầu bằng \"Theo <điều, khoản, tên văn bản> quy định:\", sau đó liệt kê đầy đủ các nội dung liên quan dưới dạng gạch đầu dòng, giữ nguyên cách diễn đạt của văn bản gốc.\nTrả lời:",
    "concise": "Các đoạn văn bản pháp luật:\n{context}\n\nCâu hỏi: {question}\n\nChỉ sử dụng thông tin trong các đoạn văn bản trên. Trả lời ngắn gọn, không giải thích thêm.\nTrả lời:",
}


def guard(name: str, forbidden: tuple[str, ...], override: bool = False) -> None:
    """Refuse inputs of the other task by the marks in their names."""
    if not override and any(mark in name for mark in forbidden):
        raise ValueError(f"{name!r} belongs to the other task")


def contexts(run: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """(``qid``, ``context_ids``, ``passages``): the texts of the first k documents, '' where one is unknown."""
    top = run.filter(F.col("rank") <= k).join(corpus.select("doc_id", "text"), "doc_id", "left")
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    return top.groupBy("qid").agg(items.alias("_i")).select(
        "qid", F.transform("_i", lambda x: x["doc_id"]).alias("context_ids"), F.transform("_i", lambda x: x["text"]).alias("passages")
    )


def format_context(ids: Column, passages: Column, max_chars: int = 1500) -> Column:
    numbered = F.transform(
        passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.element_at(ids, i + 1), F.lit(") "), shorten(p, max_chars))
    )
    return F.array_join(numbered, "\n\n")


def prompts(questions: DataFrame, made: DataFrame, variant: str = "grounded", max_chars: int = 1500, wording: str | None = None) -> DataFrame:
    """(``qid``, ``prompt``) of questions (``qid``, ``text``) with their contexts, by a variant or by one's own ``wording``
    with {context} before {question}."""
    if wording is None and variant not in PROMPTS:
        raise ValueError(f"variant must be one of {sorted(PROMPTS)}, not {variant!r}")
    before, after = (wording or PROMPTS[variant]).split("{context}")
    middle, end = after.split("{question}")
    rows = questions.select("qid", "text").join(made, "qid")
    return rows.select(
        "qid",
        F.concat(F.lit(before), format_context(F.col("context_ids"), F.col("passages"), max_chars), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end)).alias("prompt"),
    )


def extractive_answers(made: DataFrame) -> DataFrame:
    return made.select("qid", F.array_join("passages", " ").alias("answer"), "context_ids")


def oracle_ceiling(gold: DataFrame, made: DataFrame) -> DataFrame:
    """One row (``n``, ``contained``, ``share``): gold answers that stand verbatim in their context."""
    rows = gold.select("qid", "answer").join(extractive_answers(made).withColumnRenamed("answer", "_c"), "qid", "left")
    hit = (normalize(F.col("answer")) != "") & normalize(F.coalesce("_c", F.lit(""))).contains(normalize(F.col("answer")))
    return rows.agg(F.count("*").alias("n"), F.count_if(hit).alias("contained"), F.round(F.avg(hit.cast("int")), 6).alias("share"))


def generate(prompted: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """(``qid``, ``answer``) by a model function over batches of prompts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["prompt"].tolist()
            out = [a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])]
            yield pd.DataFrame({"qid": part["qid"], "answer": out})

    return prompted.select("qid", "prompt").mapInPandas(run, "qid string, answer string")


def span_answers(questions: DataFrame, made: DataFrame, reader: Callable[[list[str], list[str]], list[tuple[str, float]]], batch: int = 16) -> DataFrame:
    """(``qid``, ``answer``, ``score``, ``doc_id``): the best span of each question's passages by a reader function.

    ``reader`` takes questions and passages of equal number and gives a span and its score
    for each. Of equal scores the earlier passage counts; a question without passages has no row.
    """
    pairs = questions.select("qid", F.coalesce("text", F.lit("")).alias("question")).join(made, "qid")
    pairs = pairs.select("qid", "question", "context_ids", F.posexplode("passages").alias("pos", "passage"))
    pairs = pairs.select("qid", "question", "pos", F.element_at("context_ids", F.col("pos") + 1).alias("doc_id"), "passage")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            q, p = part["question"].tolist(), part["passage"].tolist()
            out = [x for i in range(0, len(q), batch) for x in reader(q[i : i + batch], p[i : i + batch])]
            yield part[["qid", "pos", "doc_id"]].assign(answer=[a for a, _ in out], score=[float(s) for _, s in out])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    spans = pairs.mapInPandas(run, f"qid {kinds['qid']}, pos int, doc_id {kinds['doc_id']}, answer string, score double")
    best = spans.groupBy("qid").agg(F.max_by(F.struct("answer", "score", "doc_id"), F.struct("score", -F.col("pos"))).alias("_b"))
    return best.select("qid", "_b.answer", "_b.score", "_b.doc_id")


def length_report(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: mean words of both, their ratio and a flag for answers too short or too long."""
    a = gold.agg(F.avg(word_count(F.col("answer"))).alias("_g"))
    b = predictions.agg(F.avg(word_count(F.col("answer"))).alias("_p"))
    ratio = F.coalesce(F.try_divide("_p", "_g"), F.lit(0.0))
    return a.crossJoin(F.broadcast(b)).select(  # one row each
        F.round("_g", 6).alias("gold_words"), F.round("_p", 6).alias("pred_words"), F.round(ratio, 6).alias("ratio"),
        F.when(ratio < 0.6, "short").when(ratio > 2.0, "long").otherwise("ok").alias("flag"),
    )
