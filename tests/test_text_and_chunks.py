import unicodedata

import pytest
from pyspark.sql import functions as F

from quillet.functions import text as tx
from quillet.operators import chunk
from quillet.operators.dataset import percentiles


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Hoà giải", "hòa giải"), ("Khoẻ mạnh", "khỏe mạnh"), ("Thuỷ lợi", "thủy lợi"), ("Toàn bộ", "toàn bộ"),
        ("HOÀ", "hòa"), (unicodedata.normalize("NFD", "Điều"), "điều"), ("a​b", "ab"), ("a  b  c", "a b c"), (None, ""), ("  ", ""),
    ],
)
def test_normalize(spark, given, expected):
    assert one(spark, given, tx.normalize) == expected
    assert one(spark, expected, tx.normalize) == expected


def test_normalize_keeps_lines(spark):
    made = one(spark, " a \t b \r\n\r\n\r\n\n c ", lambda c: tx.normalize(c, keep_newlines=True))
    assert made == "a b\n\nc"


def test_tokens(spark):
    assert "100/2019/nđ-cp" in one(spark, "Nghị định 100/2019/NĐ-CP.", tx.tokenize)
    assert one(spark, "và của và luật", lambda c: tx.tokenize(c, stopwords=True)) == ["luật"]
    assert one(spark, "..ab-/ --", tx.tokenize) == ["ab"]
    assert one(spark, "straße", tx.tokenize) == ["stra", "e"]
    assert one(spark, "straße", lambda c: tx.tokenize(c, token_class="unicode")) == ["straße"]
    assert one(spark, None, tx.tokenize) == []


def test_words(spark):
    assert one(spark, "một hai ba  bốn", tx.word_count) == 4
    assert one(spark, "", tx.word_count) == 0 and one(spark, "  ", tx.word_count) == 0 and one(spark, None, tx.word_count) == 0
    assert one(spark, "Trả lời: Có.\n\nThêm", tx.postprocess_answer) == "Có."
    assert one(spark, "abcdef", lambda c: tx.shorten(c, 3)) == "abc …"
    assert one(spark, " A  b", tx.fingerprint) == one(spark, "a b ", tx.fingerprint) and one(spark, " ", tx.fingerprint) is None
    assert one(spark, "Điều nđ-cp", lambda c: tx.expand(c, {"nđ-cp": "nghị định"})) == "Điều nghị định"


def test_articles(spark):
    docs = spark.createDataFrame(
        [("740", "Tiêu đề\nĐiều 1. A\n1. x\n2. y\nĐiều 2. B\n1. z", None), ("8", "Điều 1. a\nĐIỀU 2: b\nĐiều 1. c\nĐiều 1. d", "T"), ("9", "Điều 1. A Điều 2. B", ""), ("10", None, None)],
        "doc_id string, text string, title string",
    )
    made = {r.doc_id: r.text for r in chunk.build_corpus(docs, "article", min_chars=1).collect()}
    assert set(made) == {"740#dieu_preamble", "740#dieu1", "740#dieu2", "8#dieu1", "8#dieu2", "8#dieu1@1", "8#dieu1@2", "9#dieu1"}
    assert made["8#dieu1@2"] == "T\nĐiều 1. d"
    clauses = {r.doc_id for r in chunk.build_corpus(docs, "clause", min_chars=1).collect()}
    assert {"740#dieu1#khoan1", "740#dieu1#khoan2", "740#dieu2#khoan1", "9#dieu1#khoan_whole"} <= clauses
    assert chunk.build_corpus(docs, "document").count() == 2
    with pytest.raises(ValueError):
        chunk.build_corpus(docs, "page")


@pytest.mark.parametrize("n, size, stride", [(0, 3, 2), (3, 3, 2), (4, 3, 2), (10, 4, 3), (11, 4, 4), (7, 2, 1)])
def test_windows(spark, n, size, stride):
    w = [f"w{i}" for i in range(n)]
    text = " ".join(w)
    expected = [text] if n <= size else [" ".join(w[i : i + size]) for i in range(0, max(n - size + stride, 1), stride)]
    assert one(spark, text, lambda c: chunk.windows(c, size, stride)) == expected


def test_parents(spark):
    run = spark.createDataFrame([("q", "740#dieu1", 5.0), ("q", "740#dieu2", 3.0), ("q", "x", 1.0)], "qid string, doc_id string, score double")
    parents = spark.createDataFrame([("740#dieu1", "740"), ("740#dieu2", "740")], "doc_id string, parent_id string")
    for how, score in (("max", 5.0), ("sum", 8.0), ("mean", 4.0)):
        made = {r.doc_id: r.score for r in chunk.aggregate_to_parent(run, parents, how).collect()}
        assert made == {"740": score, "x": 1.0}


def test_percentile_is_an_item(spark):
    df = spark.range(10).select(F.col("id").alias("x"))
    row = percentiles(df, "x", {"p90": 0.9, "p50": 0.5}, [F.count("*").alias("n")]).first()
    assert (row.n, row.p90, row.p50) == (10, 9, 5)
