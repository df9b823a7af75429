"""Queries take all of their tables, also what the SQL leaves out."""

import shutil

import pytest

from quillet.operators import fusion
from quillet.plans import catalog
from quillet.plans import views as v

ITEMS = "run_id string, qid string, ranked array<struct<doc_id:string,score:double>>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Question d is for development, 7 is not and has two runs of bm25 and of cross."""
    made = tmp_path_factory.mktemp("whole")
    runs = [
        ("bm25-1", "d", [("a", 3.0), ("b", 2.0)]), ("cross-1", "d", [("b", 1.0)]), ("bm25-1", "7", [("a", 9.0), ("b", 5.0)]),
        ("bm25-2", "7", [("b", 8.0), ("c", 4.0)]), ("cross-1", "7", [("b", 2.0)]), ("cross-2", "7", [("a", 2.0)]), ("qlm-1", "7", [("c", 1.0)]),
    ]
    predictions = [
        ("bm25-1", "d", ["a"], 1), ("bm25-1", "7", ["x"], 1), ("bm25-1", "7", ["a", "b"], 2), ("dense-1", "7", ["c"], 1), ("dense-1", "d", [None], 1),
    ]
    spark.createDataFrame(runs, ITEMS).write.parquet(f"{made}/runs.parquet")
    spark.createDataFrame(predictions, "run_id string, qid string, predicted array<string>, saved_at int").write.parquet(f"{made}/predictions.parquet")
    dev = [("d", "t", ["a"], "s", 1)]
    spark.createDataFrame(dev, "qid string, text string, relevant array<string>, source string, loaded_at int").write.parquet(f"{made}/queries_dev.parquet")
    return str(made)


def rows(spark, folder, name):
    return catalog.queries()[name](spark, folder).collect()


def test_nesting_takes_every_run(spark, folder):
    assert len(rows(spark, folder, "nest_run")) == 7
    got = {(r.run_id, r.qid, r.pos, r.doc_id) for r in rows(spark, folder, "unnest_predictions")}
    assert got == {("bm25-1", "d", 1, "a"), ("bm25-1", "7", 1, "a"), ("bm25-1", "7", 2, "b"), ("dense-1", "7", 1, "c"), ("dense-1", "d", 1, None)}


def test_fusion_takes_every_run(spark, folder):
    got = {r.doc_id: r.score for r in rows(spark, folder, "rrf") if r.qid == "7"}
    assert got == pytest.approx({"a": 2 / 61, "b": 1 / 62 + 2 / 61, "c": 1 / 62 + 1 / 61}, abs=1e-9)
    wanted = {
        "minmax": {"a": 0.6, "b": 0.6, "c": 0.1},
        "sum": {"a": 0.4 * 9 / 14 + 0.2, "b": 0.4 * (5 / 14 + 8 / 12) + 0.2, "c": 0.4 * 4 / 12 + 0.1},
        "zscore": {"a": 0.4, "b": 0.0, "c": -0.4},
    }
    for method, want in wanted.items():
        assert {r.doc_id: r.score for r in rows(spark, folder, f"weighted_{method}") if r.qid == "7"} == pytest.approx(want, abs=1e-8)


def test_missing_scores_of_several_lists(spark, folder):
    got = {r.doc_id: r.score for r in fusion.weighted([v.all_runs(spark, folder, "cross")], [0.5], missing=0.2).collect() if r.qid == "7"}
    assert got == pytest.approx({"a": 0.6, "b": 0.6})


def test_reranking_takes_every_pair_of_runs(spark, folder):
    got = {(r.run_id, r.scorer_id, r.qid, r.doc_id): r.score for r in rows(spark, folder, "rerank_merge")}
    assert got == {
        ("bm25-1", "cross-1", "d", "a"): 0.0, ("bm25-1", "cross-1", "d", "b"): 1.0,
        ("bm25-1", "cross-1", "7", "a"): 0.0, ("bm25-1", "cross-1", "7", "b"): 2.0, ("bm25-1", "cross-2", "7", "a"): 2.0, ("bm25-1", "cross-2", "7", "b"): 0.0,
        ("bm25-2", "cross-1", "7", "b"): 2.0, ("bm25-2", "cross-1", "7", "c"): 0.0, ("bm25-2", "cross-2", "7", "b"): 0.0, ("bm25-2", "cross-2", "7", "c"): 0.0,
    }


@pytest.mark.parametrize("rule, kept", [("top_k", ["a", "b"]), ("ratio", ["a"]), ("threshold", ["a"]), ("gap", ["a"])])
def test_cutoffs_take_every_run(spark, folder, rule, kept):
    got = {(r.run_id, r.qid): r.predicted for r in rows(spark, folder, f"cutoff_{rule}")}
    assert len(got) == 7 and got["bm25-1", "7"] == kept


def test_every_submission_is_checked(spark, folder):
    got = {(r.problem, r.run_id, r.qid) for r in rows(spark, folder, "submission_checks")}
    assert got == {("extra", "bm25-1", "7"), ("extra", "dense-1", "7"), ("null_ids", "dense-1", "d")}


def test_split_leaves_out_questions_with_blank_gold_only(spark, tmp_path):
    docs = [("full", "x"), ("blank", "\u00a0\n"), ("null", None)]
    corpus = spark.createDataFrame([(k, t, ("t",), 1) for k, t in docs], "doc_id string, text string, meta struct<title:string>, loaded_at int")
    corpus.write.parquet(f"{tmp_path}/corpus_document.parquet")
    gold = {"both": ["blank", "null#dieu1"], "some": ["blank", "full"], "absent": ["blank", "gone"], "none": [], "unknown": None}
    train = spark.createDataFrame([(q, "t", g, "s", 1) for q, g in gold.items()], "qid string, text string, relevant array<string>, source string, loaded_at int")
    train.write.parquet(f"{tmp_path}/queries_train.parquet")
    assert {r.qid for r in rows(spark, str(tmp_path), "dev_split")} == {"some", "absent", "none", "unknown"}
    assert {(r.stratum, r.n_all) for r in rows(spark, str(tmp_path), "dev_split_report")} == {(0, 2), (2, 2)}


def test_reranking_scores_fifty(spark, tmp_path):
    runs = [("bm25-1", "d", [(f"{i:02}", 100.0 - i) for i in range(1, 53)]), ("cross-1", "d", [("50", 9.0), ("51", 99.0)])]
    spark.createDataFrame(runs, ITEMS).write.parquet(f"{tmp_path}/runs.parquet")
    dev = [("d", "t", ["50"], "s", 1)]
    spark.createDataFrame(dev, "qid string, text string, relevant array<string>, source string, loaded_at int").write.parquet(f"{tmp_path}/queries_dev.parquet")
    got = {r["rank"]: r.doc_id for r in rows(spark, str(tmp_path), "rerank_merge")}
    assert got[1] == "50" and (got[51], got[52]) == ("51", "52")
    assert [tuple(r) for r in rows(spark, str(tmp_path), "ceiling_verdict")] == [(1.0, 1.0, "RETRIEVER/stop")]


def test_prompts_hold_passages_of_1500_characters(spark, folder, tmp_path):
    shutil.copytree(folder, tmp_path, dirs_exist_ok=True)
    corpus = spark.createDataFrame([("a", "x" * 1500, ("t",), 1), ("b", "y" * 1501, ("t",), 1)], "doc_id string, text string, meta struct<title:string>, loaded_at int")
    corpus.write.parquet(f"{tmp_path}/corpus_document.parquet")
    (made,) = rows(spark, str(tmp_path), "prompt_build")
    assert "x" * 1500 + "\n" in made.prompt and "y" * 1500 + " …" in made.prompt


def test_ligatures_beside_look_alikes(spark):
    from quillet.llm.textform import canonical_text

    texts = ["\ufb01le \u0441ar \u2160", "file car I", "\ufb01le", "\u0416\u2161", "\ufb01l\u0435", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r.canonical for r in canonical_text(df, "t").orderBy("id").collect()]
    assert got == ["file car I", "file car I", "file", "\u0416II", "file", None]


@pytest.mark.parametrize("question, answer, expected", [("Phí?", "phí.", "copy"), ("Phí?", "Thuế.", None), ("?", "Phí.", None)])
def test_copies_of_short_questions(question, answer, expected):
    from quillet.llm import defects

    assert defects.defect(question, answer, {}, defects._automaton()) == expected
