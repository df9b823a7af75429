"""BM25 over many questions: shares of documents and questions, approximate scores and exact ones."""

import math
import random

import pytest

from quillet.operators import retrieval


def plain(docs, asked, k1, b, k):
    toks = {d: t.split() for d, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in asked:
        scores = []
        for d, t in toks.items():
            s = 0.0
            for w in text.split():
                if f := t.count(w):
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avg))
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        out.update({(k1, b, q, i): (d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)})
    return out


@pytest.mark.parametrize("held, alone, cells", [(24_000_000, 0.003, 4_000_000), (2_000, 0.2, 900), (2_000, 2.0, 900)])
def test_shares_and_blocks_change_nothing(spark, monkeypatch, held, alone, cells):
    """Many ties, documents in several shares, terms multiplied or added: the same lists as by plain sums."""
    for name, value in (("HELD", held), ("ALONE", alone), ("CELLS", cells), ("PACK", 16), ("LISTED", 64)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = [(f"{i}", texts[i % 150]) for i in range(220)]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(140)]
    index = retrieval.token_index(spark.createDataFrame(docs, "doc_id string, text string").repartition(3))
    settings = [(0.9, 0.3), (1.2, 0.75)]
    want = {x: y for k1, b in settings for x, y in plain(docs, asked, k1, b, 7).items()}
    found = retrieval.bm25_search(index, spark.createDataFrame(asked, "qid string, text string"), settings, 7, block=64, digits=6).collect()
    assert {(r.k1, r.b, r.qid, r["rank"]): (r.doc_id, r.score) for r in found} == want


def test_a_grid_moves_its_lists_once():
    """16 settings of 12,000 questions over 36,000 documents: one list per question and setting, the small index is copied."""
    docs, shares = retrieval._tiles(12, 6_900_000, 12_000 * 16 * 100, 12_000)
    assert docs == 1 and shares == 12
    docs, shares = retrieval._tiles(12, 106_000_000, 92_000 * 100, 92_000)
    assert docs * retrieval.HELD >= 106_000_000 and docs * shares >= 12
    assert retrieval._tiles(12, 0, 0, 0) == (1, 1)


def test_terms_by_ranges(spark):
    """The class of a term's characters is made of ranges, and holds the same characters; white space need not be made one space before."""
    from pyspark.sql import functions as F

    from quillet.functions import text as tx

    assert len(tx._ranges(tx.LETTERS)) < len(tx.LETTERS) / 2
    every = spark.range(1, 0xD800).select(F.col("id"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = {chr(r.id) for r in every.filter(F.size(tx.tokens_of(F.concat(F.lit("a"), "c", F.lit("a")))) == 1).collect()}
    assert found == {*tx.LETTERS, *"0123456789_/.-"}
    odd = spark.createDataFrame([("  a\x85b -c-\n./d/.\t É x.y ./- ",), ("",), (None,)], "t string")
    for r in odd.select(tx.tokenize(F.col("t")).alias("a"), tx.tokens_of(tx.normalize(F.col("t"))).alias("b")).collect():
        assert r.a == r.b


def test_terms_within_python(spark):
    """What makes the terms of texts that are packed, and what strips pieces, does what the expressions of Spark do, for every character."""
    from pyspark.sql import functions as F

    from quillet.functions import text as tx

    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "c string")
    texts = every.select(F.concat(F.lit("oà"), "c", F.lit("./A"), "c", F.lit("1 "), "c").alias("t")).unionByName(spark.createDataFrame([("",), (None,), (" ./- ",), ("HÒA hoà quỳ-. 10/2019/NĐ-CP",)], "t string"))
    for r in texts.select("t", tx.tokenize(F.col("t")).alias("want")).toLocalIterator():
        assert tx.terms(r.t) == r.want, repr(r.t)
    around = every.select(F.concat("c", F.lit("\n"), "c", F.lit("a"), "c", F.lit("b "), "c").alias("t"))
    assert around.filter(tx.stripped(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).isEmpty()


def test_pools_keep_whole_candidates():
    """Candidates are found by eights, and floors come from one sort: all that reach the k-th score stay, in any order of documents."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((7, 13), (64, 3), (5, 40)):
        mask = rng.random((m, n)) < 0.1
        assert (retrieval._found(mask) == np.flatnonzero(mask)).all()
        pool = retrieval._Pool(n, 4, np.full(n, 1e-6), 6)
        scores = np.where(rng.random((3 * m, n)) < 0.3, 0, rng.integers(1, 9, (3 * m, n))).astype(np.float32)
        for begin in range(0, 3 * m, m):
            pool.add(scores[begin : begin + m], begin)
        pool.shrink()
        for q in range(n):
            reached = np.sort(scores[:, q][scores[:, q] > 0])[::-1]
            least = reached[3] if len(reached) > 3 else 1
            assert {*pool.d[pool.q == q]} == {*np.flatnonzero(scores[:, q] >= least)}
