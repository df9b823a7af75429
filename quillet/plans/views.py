"""The tables of the project as the core operators take them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import normalize_sql, tokens_sql
from quillet.sources.rankings import latest, qrels, ranked, run_items

KINDS = ("bm25", "dense", "cross", "qlm")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, title, parent_id), each id once: as it was loaded last."""
    rows = table(spark, d, "corpus_document").select("doc_id", "text", F.col("meta.title").alias("title"), "loaded_at")
    return latest(rows, ["doc_id"], "loaded_at").withColumn("parent_id", F.regexp_replace("doc_id", "#.*$", "")).drop("loaded_at")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).filter(~F.col("doc_id").contains("#"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).filter(F.col("doc_id").contains("#"))


def questions(spark: SparkSession, d: str, name: str = "queries_dev") -> DataFrame:
    rows = table(spark, d, name).select("qid", "text", "relevant", "source", "loaded_at")
    return latest(rows, ["qid"], "loaded_at")


def gold(spark: SparkSession, d: str, name: str = "queries_dev") -> DataFrame:
    return qrels(questions(spark, d, name))


def run(spark: SparkSession, d: str, kind: str = "bm25") -> DataFrame:
    """The rankings of one kind for the development questions."""
    own = table(spark, d, "runs").filter(F.col("run_id").startswith(kind))
    own = own.join(table(spark, d, "queries_dev").select("qid").distinct(), "qid", "left_semi")
    return ranked(run_items(own, ["qid"]), ["qid"])


def predictions(spark: SparkSession, d: str, kind: str = "bm25") -> DataFrame:
    rows = table(spark, d, "predictions").filter(F.col("run_id").startswith(kind)).select("qid", "predicted", "saved_at")
    asked = table(spark, d, "queries_dev").select("qid").distinct()
    return latest(rows.join(asked, "qid", "left_semi"), ["qid"], "saved_at").select("qid", "predicted")


def all_runs(spark: SparkSession, d: str, kind: str = "") -> DataFrame:
    """Every ranking of one kind, or of all, by (run_id, qid); also of questions that are not for development."""
    keys = ["run_id", "qid"]
    return ranked(run_items(table(spark, d, "runs").filter(F.col("run_id").startswith(kind)), keys), keys)


def all_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The latest prediction of every (run_id, qid)."""
    rows = table(spark, d, "predictions").select("run_id", "qid", "predicted", "saved_at")
    return latest(rows, ["run_id", "qid"], "saved_at").drop("saved_at")


def answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task2_train").select("qid", "text", "answer", "loaded_at")
    return latest(rows, ["qid"], "loaded_at").select("qid", "text", "answer")


def _run_sql(kind: str) -> str:
    return f"""(SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM (SELECT qid, i.doc_id AS doc_id, max(i.score) AS score FROM (SELECT qid, unnest(ranked) AS i FROM runs
      WHERE starts_with(run_id, '{kind}') AND qid IN (SELECT qid FROM queries_dev))
      WHERE i.doc_id IS NOT NULL AND i.score IS NOT NULL AND NOT isnan(i.score) GROUP BY ALL))"""


def _predictions_sql(kind: str) -> str:
    return f"""(SELECT qid, predicted FROM predictions WHERE starts_with(run_id, '{kind}') AND qid IN (SELECT qid FROM queries_dev)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY saved_at DESC NULLS LAST, predicted DESC NULLS LAST) = 1)"""


def _all_runs_sql(kind: str = "") -> str:
    return f"""(SELECT run_id, qid, doc_id, score, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM (SELECT run_id, qid, i.doc_id AS doc_id, max(i.score) AS score FROM (SELECT run_id, qid, unnest(ranked) AS i FROM runs WHERE starts_with(run_id, '{kind}'))
      WHERE i.doc_id IS NOT NULL AND i.score IS NOT NULL AND NOT isnan(i.score) GROUP BY ALL))"""


ALL_PREDICTIONS_SQL = """(SELECT run_id, qid, predicted FROM predictions
    QUALIFY row_number() OVER (PARTITION BY run_id, qid ORDER BY saved_at DESC NULLS LAST, predicted DESC NULLS LAST) = 1)"""


def _bm25_sql(docs: str, k1: float = 1.2, b: float = 0.75) -> dict[str, str]:
    return {
        "toks": f"(SELECT doc_id, {tokens_sql(normalize_sql('text'))} AS t FROM {docs})",
        "tf": "(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL)",
        "sizes": "(SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks)",
        "stats": "(SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, sizes GROUP BY term, n)",
        "qt": f"(SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens_sql(normalize_sql('text'))}) AS term FROM dev) GROUP BY ALL)",
        "matches": "(SELECT qid, tf.doc_id, len(t) AS dl, tf.tf, idf * qtf AS w FROM qt JOIN stats USING (term) JOIN tf USING (term) JOIN toks ON toks.doc_id = tf.doc_id)",
        "scored": f"""(SELECT qid, doc_id, round(sum(w * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM matches, sizes GROUP BY qid, doc_id)""",
        "found": "(SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 100)",
    }


def with_sql(*names: str, **more: str) -> str:
    """The WITH clause of the named views and of further ones."""
    views = {
        "corpus": """(SELECT doc_id, text, meta.title AS title, regexp_replace(doc_id, '#.*$', '') AS parent_id FROM corpus_document
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) = 1)""",
        "docs": "(SELECT * FROM corpus WHERE NOT contains(doc_id, '#'))",
        "arts": "(SELECT * FROM corpus WHERE contains(doc_id, '#'))",
        "dev": """(SELECT qid, text, relevant, source FROM queries_dev
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, relevant DESC NULLS LAST) = 1)""",
        "train": """(SELECT qid, text, relevant, source FROM queries_train
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, relevant DESC NULLS LAST) = 1)""",
        "gold": "(SELECT DISTINCT qid, regexp_replace(id, '(#|::).*$', '') AS doc_id FROM (SELECT qid, unnest(relevant) AS id FROM dev) WHERE id IS NOT NULL)",
        "train_gold": "(SELECT DISTINCT qid, regexp_replace(id, '(#|::).*$', '') AS doc_id FROM (SELECT qid, unnest(relevant) AS id FROM train) WHERE id IS NOT NULL)",
        "qa": """(SELECT qid, text, answer FROM task2_train
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, answer DESC NULLS LAST) = 1)""",
        **{f"run_{k}": _run_sql(k) for k in KINDS},
        **{f"pred_{k}": _predictions_sql(k) for k in KINDS},
        "all_runs": _all_runs_sql(),
        **{f"all_{k}": _all_runs_sql(k) for k in KINDS},
        "all_pred": ALL_PREDICTIONS_SQL,
    }
    needs = {"docs": ["corpus"], "arts": ["corpus"], "gold": ["dev"], "train_gold": ["train"]}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for n in needs.get(name, []):
            add(n)
        if name.startswith("bm25:"):
            add("dev")
            done.update(_bm25_sql(name[5:]))
        else:
            done.setdefault(name, views[name])

    for n in names:
        add(n)
    done.update({k: f"({v})" if not v.lstrip().startswith("(") else v for k, v in more.items()})
    return "WITH " + ",\n  ".join(f"{k} AS {v}" for k, v in done.items()) + "\n"
