"""Queries of the core operators over the project's tables, each with its SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions import text as tx
from quillet.operators import analysis, chunk, cutoff, dataset, fusion, metrics, qa, retrieval, runs, textgen
from quillet.plans import pipelines
from quillet.plans import views as v
from quillet.plans.views import with_sql
from quillet.session import cut
from quillet.sources import files, rankings
from quillet.streaming.retrieval import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


R6 = lambda x: f"round(CAST({x} AS DOUBLE), 6)"
INT = lambda x: f"CAST({x} AS INTEGER)"

# --- text


@query(with_sql("corpus") + f"SELECT doc_id, {tx.normalize_sql('text')} AS text FROM corpus")
def normalize_text(spark, d):
    return v.corpus(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query(with_sql("corpus") + f"SELECT doc_id, {tx.compose_sql('text')} AS text FROM corpus")
def tone_normalize(spark, d):
    return v.corpus(spark, d).select("doc_id", tx.compose(F.coalesce("text", F.lit(""))).alias("text"))


@query(with_sql("corpus") + f"SELECT doc_id, 'passage: ' || {tx.normalize_sql('text', lower=False)} AS text FROM corpus")
def encoder_text(spark, d):
    return v.corpus(spark, d).select("doc_id", tx.encoder_text(F.col("text"), "passage: ").alias("text"))


@query(with_sql("corpus", t=f"SELECT doc_id, unnest({tx.tokens_sql(tx.normalize_sql('text'))}) AS term FROM corpus") + "SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def tokenize_terms(spark, d):
    return v.corpus(spark, d).select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(with_sql("corpus") + f"SELECT doc_id, {INT(f'len({tx.tokens_sql(tx.normalize_sql("text"))})')} AS n_tokens, {INT(f'len({tx.words_sql("text")})')} AS n_words FROM corpus")
def token_count(spark, d):
    return v.corpus(spark, d).select("doc_id", F.size(tx.tokenize(F.col("text"))).alias("n_tokens"), tx.word_count(F.col("text")).alias("n_words"))


@query(
    with_sql("corpus", t=f"SELECT doc_id, unnest({tx.tokens_sql(tx.normalize_sql('text'))}) AS term FROM corpus")
    + f"SELECT term, count(DISTINCT doc_id) AS df, {R6('ln(1 + (n - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5))')} AS idf FROM t, (SELECT count(*) AS n FROM corpus) GROUP BY term, n"
)
def token_df_idf(spark, d):
    docs = v.corpus(spark, d)
    return retrieval.term_stats(retrieval.postings(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    with_sql("corpus", t=f"SELECT unnest({tx.tokens_sql(tx.normalize_sql('text'))}) AS term FROM corpus")
    + f"SELECT term, count(*) AS n FROM t WHERE term NOT IN ({', '.join(repr(w) for w in tx.STOPWORDS)}) GROUP BY term"
)
def stopword_terms(spark, d):
    return v.corpus(spark, d).select(F.explode(tx.tokenize(F.col("text"), stopwords=True)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    with_sql("corpus", f=f"SELECT DISTINCT doc_id, lower({tx.blank_sql('text')}) AS t FROM corpus WHERE text IS NOT NULL")
    + "SELECT sha1(t) AS fingerprint, count(*) AS n_docs, min(doc_id) AS first_doc FROM f WHERE t <> '' GROUP BY 1 HAVING count(*) > 1"
)
def dup_fingerprint_groups(spark, d):
    return analysis.duplicate_passages(v.corpus(spark, d))


@query(
    with_sql("qa", a="SELECT qid, regexp_replace(trim(coalesce(answer, ''), ' \t\n\r  　'), '^(Trả lời:|Answer:)[\\s\\x{A0}\\x{202F}\\x{3000}]*', '') AS t FROM qa")
    + "SELECT qid, trim(split_part(t, chr(10) || chr(10), 1), ' \t\n\r  　') AS answer FROM a"
)
def postprocess_answer(spark, d):
    return v.answers(spark, d).select("qid", tx.postprocess_answer(F.col("answer")).alias("answer"))


@query(with_sql("qa") + "SELECT qid, CASE WHEN length(answer) > 120 THEN substr(answer, 1, 120) || ' …' ELSE answer END AS answer FROM qa")
def shorten_answer(spark, d):
    return v.answers(spark, d).select("qid", tx.shorten(F.col("answer"), 120).alias("answer"))


# --- chunks

_ARTICLES = (
    "SELECT doc_id AS parent_id, coalesce(title, '') AS title, text, "
    "regexp_replace(coalesce(text, ''), '(?im)^([ \\t]*điều\\s+\\d+)', chr(1) || '\\1', 'g') AS m FROM docs"
)
_PIECES = (
    "SELECT parent_id, title, CAST(pos - 1 AS INTEGER) AS pos, piece0, contains(m, chr(1)) AS cut FROM "
    "(SELECT parent_id, title, m, unnest(string_split(m, chr(1))) AS piece0, generate_subscripts(string_split(m, chr(1)), 1) AS pos FROM articled)"
)
_LABELLED = (
    "SELECT parent_id, title, pos, CASE WHEN NOT cut THEN '_whole' WHEN pos = 0 THEN '_preamble' ELSE regexp_extract(piece0, '(?i)^[ \\t]*điều\\s+(\\d+)', 1) END AS label, "
    f"regexp_replace(piece0, '^{tx._SPACE}+|{tx._SPACE}+$', '', 'g') AS piece FROM pieces WHERE NOT (cut AND pos = 0 AND trim(regexp_replace(piece0, '{tx._SPACE}+', '', 'g')) = '')"
)
_CHUNKS = (
    "SELECT parent_id, title, parent_id || '#dieu' || label || CASE WHEN n > 1 THEN '@' || CAST(n - 1 AS VARCHAR) ELSE '' END AS doc_id, "
    "CASE WHEN title <> '' THEN title || chr(10) || piece ELSE piece END AS text FROM "
    "(SELECT *, row_number() OVER (PARTITION BY parent_id, label ORDER BY pos) AS n FROM labelled) WHERE length(piece) >= 30"
)


def _chunk_sql(select: str) -> str:
    return with_sql("docs", articled=_ARTICLES, pieces=_PIECES, labelled=_LABELLED, chunks=_CHUNKS) + select


@query(_chunk_sql("SELECT doc_id, parent_id, text FROM chunks"))
def chunk_articles(spark, d):
    return chunk.build_corpus(v.documents(spark, d), "article").select("doc_id", "parent_id", "text")


_CLAUSES = {
    "split2": "SELECT parent_id, title, pos AS first, label AS article, regexp_replace(piece, '(?m)^([ \\t]*\\d{1,2}\\s*[.)]\\s+)', chr(1) || '\\1', 'g') AS m FROM labelled",
    "pieces2": "SELECT parent_id, title, first, article, CAST(p - 1 AS INTEGER) AS pos, piece0, contains(m, chr(1)) AS cut FROM "
    "(SELECT *, unnest(string_split(m, chr(1))) AS piece0, generate_subscripts(string_split(m, chr(1)), 1) AS p FROM split2)",
    "labelled2": "SELECT parent_id, title, first, pos, article, CASE WHEN NOT cut THEN '_whole' WHEN pos = 0 THEN '_preamble' ELSE regexp_extract(piece0, '^[ \\t]*(\\d{1,2})', 1) END AS label, "
    f"regexp_replace(piece0, '^{tx._SPACE}+|{tx._SPACE}+$', '', 'g') AS piece FROM pieces2 WHERE NOT (cut AND pos = 0 AND regexp_replace(piece0, '{tx._SPACE}+', '', 'g') = '')",
    "clauses": "SELECT parent_id, parent_id || '#dieu' || article || '#khoan' || label || CASE WHEN n > 1 THEN '@' || CAST(n - 1 AS VARCHAR) ELSE '' END AS doc_id, "
    "CASE WHEN title <> '' THEN title || chr(10) || piece ELSE piece END AS text FROM "
    "(SELECT *, row_number() OVER (PARTITION BY parent_id, article, label ORDER BY first, pos) AS n FROM labelled2) WHERE length(piece) >= 30",
}


@query(with_sql("docs", articled=_ARTICLES, pieces=_PIECES, labelled=_LABELLED, **_CLAUSES) + "SELECT doc_id, parent_id, text FROM clauses")
def chunk_clauses(spark, d):
    return chunk.build_corpus(v.documents(spark, d), "clause").select("doc_id", "parent_id", "text")


@query(
    with_sql("docs", w=f"SELECT doc_id, text, {tx.words_sql('text')} AS w FROM docs WHERE length(regexp_replace(text, '^{tx._SPACE}+|{tx._SPACE}+$', '', 'g')) >= 30")
    + "SELECT doc_id || '::w' || CAST(i AS VARCHAR) AS doc_id, array_to_string(list_slice(w, i * 48 + 1, i * 48 + 64), ' ') AS text FROM "
    "(SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 64 + 48, 1) / 48.0) AS BIGINT))) AS i FROM w WHERE len(w) > 64) "
    f"UNION ALL SELECT doc_id || '::w0', regexp_replace(text, '^{tx._SPACE}+|{tx._SPACE}+$', '', 'g') FROM w WHERE len(w) <= 64"
)
def chunk_windows(spark, d):
    return chunk.build_corpus(v.documents(spark, d), "document", window=64, stride=48).select("doc_id", "text")


@query(
    _chunk_sql(
        f"SELECT count(*) AS n_chunks, count(DISTINCT parent_id) AS n_parents, {R6('avg(n)')} AS len_mean, {INT('max(n)')} AS len_max, "
        + ", ".join(f"{INT(f'list_sort(list(n))[least(CAST(floor({p} * count(*)) AS BIGINT), count(*) - 1) + 1]')} AS len_p{int(p * 100)}" for p in (0.5, 0.9, 0.99))
        + f" FROM (SELECT parent_id, len({tx.words_sql('text')}) AS n FROM chunks)"
    )
)
def chunk_stats(spark, d):
    return chunk.corpus_stats(chunk.build_corpus(v.documents(spark, d), "article"))


@query(
    with_sql("docs", articled=_ARTICLES, pieces=_PIECES, labelled=_LABELLED, chunks=_CHUNKS, **_CLAUSES)
    + " UNION ALL ".join(
        f"SELECT '{g}' AS granularity, count(*) AS n, CAST(sum(len({tx.words_sql('text')})) AS BIGINT) AS n_words FROM {t}"
        for g, t in (("document", f"docs WHERE length(regexp_replace(coalesce(text, ''), '^{tx._SPACE}+|{tx._SPACE}+$', '', 'g')) >= 30"), ("article", "chunks"), ("clause", "clauses"))
    )
)
def corpus_size_by_granularity(spark, d):
    docs = cut(v.documents(spark, d))
    parts = [chunk.build_corpus(docs, g).groupBy("granularity").agg(F.count("*").alias("n"), F.sum(tx.word_count(F.col("text"))).alias("n_words")) for g in ("document", "article", "clause")]
    return reduce(DataFrame.unionByName, parts)


# --- retrieval


@query(with_sql("docs", "bm25:docs") + "SELECT qid, doc_id, rank, score FROM found WHERE rank <= 10")
def bm25_topk(spark, d):
    return retrieval.bm25(v.documents(spark, d), v.questions(spark, d), top_k=10, digits=6).select("qid", "doc_id", "rank", "score")


_GRID_SQL = "SELECT k1, b, qid, doc_id, round(sum(w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) AS score FROM matches, sizes, (VALUES (0.9), (1.2), (1.5), (2.0)) AS x(k1), (VALUES (0.3), (0.5), (0.75), (0.9)) AS y(b) GROUP BY ALL"


@query(
    with_sql("docs", "gold", "bm25:docs", cells=_GRID_SQL, placed="SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY score DESC, doc_id) AS rank FROM cells WHERE score > 0")
    + f"SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b, {R6('sum(h * 1.0 / g) / (SELECT count(*) FROM dev)')} AS recall_10 FROM "
    "(SELECT k1, b, p.qid, count(*) FILTER (WHERE rank <= 10) AS h, any_value(g) AS g FROM placed p JOIN gold USING (qid, doc_id) JOIN (SELECT qid, count(*) AS g FROM gold GROUP BY qid) s ON s.qid = p.qid WHERE rank <= 100 GROUP BY k1, b, p.qid) GROUP BY k1, b"
)
def bm25_grid(spark, d):
    grid = [(k1, b) for k1 in (0.9, 1.2, 1.5, 2.0) for b in (0.3, 0.5, 0.75, 0.9)]
    made = retrieval.bm25_search(retrieval.token_index(v.documents(spark, d)), v.questions(spark, d), grid, digits=6)
    return metrics.rank_metrics(v.questions(spark, d), v.gold(spark, d), made, ks=(10,), by=("k1", "b")).select("k1", "b", "recall_10")


def _parts_sql(how: str) -> str:
    return (
        with_sql("arts", "bm25:arts")
        + f"SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM "
        f"(SELECT qid, parent_id AS doc_id, round({how}(score), 9) AS score FROM found JOIN arts USING (doc_id) GROUP BY ALL) QUALIFY rank <= 100"
    )


for _how, _f in (("max", "max"), ("sum", "sum"), ("mean", "avg")):

    @query(_parts_sql(_f), f"bm25_article_{_how}")
    def _aggregated(spark, d, how=_how):
        arts = cut(v.articles(spark, d))
        return chunk.aggregate_to_parent(retrieval.bm25(arts, v.questions(spark, d), digits=6), arts, how)


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) "
    "SELECT q.vec_id AS qid, x.vec_id AS doc_id, round(list_inner_product(q.v, x.v), 4) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, x.v), 4) DESC, x.vec_id) AS INTEGER) AS rank "
    "FROM e q, e x WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"
)
def dense_topk(spark, d):
    """The stated query set, every id divisible by 100, against all rows."""
    rows = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.dense_search(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, digits=4)


# --- fusion and reranking

_FOUR = tuple(f"all_{k}" for k in v.KINDS)
_PLACED = "SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {} QUALIFY rank <= 100"


@query(
    with_sql(*_FOUR, s="SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM {r}" for r in _FOUR) + ") GROUP BY ALL") + _PLACED.format("s")
)
def rrf(spark, d):
    return fusion.rrf([v.all_runs(spark, d, k) for k in v.KINDS], digits=9)


_SCALES = {
    "minmax": "CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END",
    "zscore": "CASE WHEN stddev_pop(score) OVER w <= 1e-12 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END",
    "sum": "score / CASE WHEN sum(abs(score)) OVER w = 0 THEN 1.0 ELSE sum(abs(score)) OVER w END",
}
_WEIGHTS = (0.4, 0.3, 0.2, 0.1)


def _weighted_sql(method: str, missing: float = 0.0) -> str:
    scaled = " UNION ALL ".join(f"SELECT qid, doc_id, {w}::DOUBLE AS w, CAST({_SCALES[method]} AS DOUBLE) AS s FROM {r} WINDOW w AS (PARTITION BY run_id, qid)" for r, w in zip(_FOUR, _WEIGHTS))
    return with_sql(*_FOUR, scaled=scaled, s=f"SELECT qid, doc_id, round(sum(w * s) + {missing} * (1.0 - sum(w)), 9) + 0.0::DOUBLE AS score FROM scaled GROUP BY ALL") + _PLACED.format("s")


for _m in _SCALES:

    @query(_weighted_sql(_m), f"weighted_{_m}")
    def _weighted(spark, d, method=_m):
        return fusion.weighted([v.all_runs(spark, d, k) for k in v.KINDS], list(_WEIGHTS), method, digits=9)


_STEPS = [i / 10 for i in range(11)]


@query(
    with_sql(
        "run_dense", "run_bm25", "gold",
        scaled=" UNION ALL ".join(f"SELECT qid, doc_id, {i} AS r, CAST({_SCALES['minmax']} AS DOUBLE) AS s FROM run_{k} WINDOW w AS (PARTITION BY qid)" for i, k in enumerate(("dense", "bm25"))),
        sides="SELECT qid, doc_id, coalesce(sum(s) FILTER (WHERE r = 0), 0) AS a, coalesce(sum(s) FILTER (WHERE r = 1), 0) AS b FROM scaled GROUP BY ALL",
        cells="SELECT w, qid, doc_id, round(w * a + (1 - w) * b, 9) AS score FROM sides, (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS w)",
        placed="SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY score DESC, doc_id) AS rank FROM cells",
        hits="SELECT w, p.qid, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 100) AS h100, min(rank) AS f, any_value(g) AS g FROM placed p JOIN gold USING (qid, doc_id) JOIN (SELECT qid, count(*) AS g FROM gold GROUP BY qid) s ON s.qid = p.qid GROUP BY w, p.qid",
    )
    + f"SELECT w, {R6('sum(h100 * 1.0 / g) / (SELECT count(*) FROM dev)')} AS recall_100, {R6('sum(h10 * 1.0 / g) / (SELECT count(*) FROM dev)')} AS recall_10, {R6('sum(CASE WHEN f <= 10 THEN 1.0::DOUBLE / f ELSE 0 END) / (SELECT count(*) FROM dev)')} AS mrr_10 FROM hits GROUP BY w"
)
def fusion_weight_sweep(spark, d):
    made = fusion.sweep_weights(v.run(spark, d, "dense"), v.run(spark, d, "bm25"), _STEPS, digits=9)
    return metrics.rank_metrics(v.questions(spark, d), v.gold(spark, d), made, ks=(10, 100), by=("w",)).select("w", "recall_100", "recall_10", "mrr_10")


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    scores = v.run(spark, d, "cross").select("qid", "doc_id", F.col("score").alias("new"))
    return fusion.rerank(v.run(spark, d, "bm25"), scores)


_RERANK = {
    "head": "SELECT b.qid, b.doc_id, coalesce(c.score, 0.0::DOUBLE) AS score FROM run_bm25 b LEFT JOIN run_cross c USING (qid, doc_id) WHERE b.rank <= 50",
    "floors": "SELECT qid, min(score) AS low FROM head GROUP BY qid",
    "merged": "SELECT qid, doc_id, round(score, 7) AS score FROM head UNION ALL SELECT qid, doc_id, round(coalesce(low, 0.0::DOUBLE) - (rank - 50) * 1e-6::DOUBLE, 7) FROM run_bm25 LEFT JOIN floors USING (qid) WHERE rank > 50",
    "again": "SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM merged",
}
_RERANK_ALL = {
    "scorers": "SELECT DISTINCT run_id AS scorer_id, qid FROM all_cross",
    "paired": "SELECT b.*, coalesce(scorer_id, '') AS scorer_id FROM all_bm25 b LEFT JOIN scorers USING (qid)",
    "head": "SELECT p.run_id, p.scorer_id, p.qid, p.doc_id, coalesce(c.score, 0.0::DOUBLE) AS score FROM paired p LEFT JOIN all_cross c ON c.run_id = p.scorer_id AND c.qid = p.qid AND c.doc_id = p.doc_id WHERE p.rank <= 50",
    "floors": "SELECT run_id, scorer_id, qid, min(score) AS low FROM head GROUP BY ALL",
    "merged": "SELECT run_id, scorer_id, qid, doc_id, round(score, 7) AS score FROM head UNION ALL SELECT run_id, scorer_id, qid, doc_id, round(coalesce(low, 0.0::DOUBLE) - (rank - 50) * 1e-6::DOUBLE, 7) FROM paired LEFT JOIN floors USING (run_id, scorer_id, qid) WHERE rank > 50",
}


@query(
    with_sql("all_bm25", "all_cross", **_RERANK_ALL)
    + "SELECT run_id, scorer_id, qid, doc_id, score, CAST(row_number() OVER (PARTITION BY run_id, scorer_id, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM merged"
)
def rerank_merge(spark, d):
    """Every bm25 ranking by every cross run of its question; ``scorer_id`` is empty where there is none."""
    scores = v.all_runs(spark, d, "cross").select(F.col("run_id").alias("scorer_id"), "qid", "doc_id", F.col("score").alias("new"))
    run = v.all_runs(spark, d, "bm25").join(scores.select("scorer_id", "qid").distinct(), "qid", "left").fillna("", ["scorer_id"])
    return fusion.rerank(run, scores, keys=("run_id", "scorer_id", "qid"))


# --- metrics


def _rank_sql(run: str, columns: str, by: str = "") -> str:
    more = f"{by}, " if by else ""
    hits = f"""SELECT *, count(*) OVER (PARTITION BY {more}qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS i
      FROM {run} JOIN gold USING (qid, doc_id) JOIN (SELECT qid, count(*) AS g FROM gold GROUP BY qid) s USING (qid)"""
    each = (
        f"SELECT {more}qid, g, " + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}" for k in (1, 5, 10, 20, 50, 100))
        + ", min(rank) AS f, sum(CASE WHEN rank <= 100 THEN i::DOUBLE / rank ELSE 0 END) AS ap, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,"
        f" list_sum(list_transform(range(1, least(g, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM hits GROUP BY {more}qid, g"
    )
    return f"hits AS ({hits}), each AS ({each}) SELECT {more}{columns} FROM each" + (f" GROUP BY {by}" if by else "")


_N = "(SELECT count(*) FROM dev)"


def _ranks(ks: tuple[int, ...]) -> str:
    return ", ".join(f"{R6(f'sum(h{k}::DOUBLE / g) / {_N}')} AS recall_{k}, {R6(f'sum(h{k}::DOUBLE / {k}) / {_N}')} AS precision_{k}" for k in ks) + _LAST


_LAST = (
    f", {R6(f'sum(CASE WHEN f <= 10 THEN 1.0::DOUBLE / f ELSE 0 END) / {_N}')} AS mrr_10, {R6(f'sum(ap / least(g, 100)) / {_N}')} AS map_100, {R6(f'sum(dcg / ideal) / {_N}')} AS ndcg_10"
)


for _k in v.KINDS:

    @query(with_sql("gold", f"run_{_k}").rstrip() + ", " + _rank_sql(f"run_{_k}", _ranks((1, 5, 10, 20, 50, 100))), f"rank_metrics_{_k}")
    def _rank_metrics(spark, d, kind=_k):
        return metrics.rank_metrics(v.questions(spark, d), v.gold(spark, d), v.run(spark, d, kind))


_SCORES = """SELECT q.qid, coalesce(len(gold), 0) AS n_gold, coalesce(len(predicted), 0) AS n_pred,
  CASE WHEN coalesce(len(predicted), 0) BETWEEN 1 AND 5 THEN coalesce(len(list_intersect(list_distinct(predicted), gold)), 0) ELSE 0 END AS hit
  FROM dev q LEFT JOIN (SELECT qid, list(doc_id) AS gold FROM gold GROUP BY qid) g USING (qid) LEFT JOIN {} p USING (qid)"""
_SUMS = """SELECT *, coalesce(hit::DOUBLE / nullif(n_gold, 0), 0) AS recall, coalesce(hit::DOUBLE / nullif(n_pred, 0), 0) AS precision FROM scores"""
_SET = """SELECT count(*) AS n_queries, count(*) FILTER (WHERE n_pred > 5) AS n_over_cap, count(*) FILTER (WHERE n_pred = 0) AS n_empty,
  coalesce(sum(hit)::DOUBLE / nullif(sum(n_pred), 0), 0) AS mp, coalesce(sum(hit)::DOUBLE / nullif(sum(n_gold), 0), 0) AS mr,
  avg(precision) AS ap, avg(recall) AS ar, avg(n_pred) AS np, avg(n_gold) AS ng FROM each_scored"""


_F1 = "coalesce(2 * {0} * {1} / nullif({0} + {1}, 0), 0)"
_SET_COLUMNS = (
    f"SELECT n_queries, n_over_cap, n_empty, {R6('mp')} AS micro_precision, {R6('mr')} AS micro_recall, {R6(_F1.format('mp', 'mr'))} AS micro_f, "
    f"{R6('ap')} AS macro_precision, {R6('ar')} AS macro_recall, {R6(_F1.format('ap', 'ar'))} AS macro_f, {R6('np')} AS avg_pred, {R6('ng')} AS avg_gold FROM s"
)


def _set_sql(pred: str) -> str:
    return with_sql("gold", pred, scores=_SCORES.format(pred), each_scored=_SUMS, s=_SET) + _SET_COLUMNS


for _k in v.KINDS:

    @query(_set_sql(f"pred_{_k}"), f"metrics_official_{_k}")
    def _official(spark, d, kind=_k):
        return metrics.set_scores(metrics.question_scores(v.questions(spark, d), v.gold(spark, d), v.predictions(spark, d, kind)))


@query(
    with_sql("dev", "all_pred")
    + """SELECT run_id, 'missing' AS problem, qid FROM (SELECT DISTINCT run_id FROM all_pred), (SELECT DISTINCT qid FROM dev) WHERE (run_id, qid) NOT IN (SELECT (run_id, qid) FROM all_pred)
UNION ALL SELECT run_id, 'extra', qid FROM all_pred WHERE qid NOT IN (SELECT qid FROM dev)
UNION ALL SELECT run_id, 'over_cap', qid FROM all_pred WHERE len(predicted) > 5
UNION ALL SELECT run_id, 'duplicates', qid FROM all_pred WHERE len(list_distinct(predicted)) + list_aggregate(list_transform(predicted, lambda x: CASE WHEN x IS NULL THEN 1 ELSE 0 END), 'max') < len(predicted)
UNION ALL SELECT run_id, 'empty', qid FROM all_pred WHERE coalesce(len(predicted), 0) = 0
UNION ALL SELECT run_id, 'null_ids', qid FROM all_pred WHERE len(list_filter(predicted, lambda x: x IS NULL)) > 0"""
)
def submission_checks(spark, d):
    """Every run is a submission of its own."""
    return metrics.submission_checks(v.questions(spark, d), v.all_predictions(spark, d), by=("run_id",))


# --- cutoffs

_ALL_LISTS = "SELECT run_id, qid, list(doc_id ORDER BY rank) AS d, list(score ORDER BY rank) AS s FROM all_runs GROUP BY run_id, qid"
_LISTS = "SELECT qid, list(doc_id ORDER BY rank) AS d, list(score ORDER BY rank) AS s FROM run_bm25 GROUP BY qid"
_KEEP = {
    "top_k": "3",
    "ratio": "CASE WHEN s[1] <= 0 THEN 10 ELSE len(list_filter(s, lambda x: x >= 0.85::DOUBLE * s[1])) END",
    "threshold": "len(list_filter(s, lambda x: x >= 20))",
    "gap": "CASE WHEN len(s) < 2 THEN len(s) ELSE list_position(list_transform(range(1, least(len(s), 5)), lambda i: (s[i] - s[i + 1]) / greatest(abs(s[1]), 1e-9)), "
    "list_max(list_transform(range(1, least(len(s), 5)), lambda i: (s[i] - s[i + 1]) / greatest(abs(s[1]), 1e-9)))) END",
}
_VALUES = {"top_k": 3, "ratio": 0.85, "threshold": 20.0, "gap": None}

for _rule in _KEEP:

    @query(with_sql("all_runs", lists=_ALL_LISTS) + f"SELECT run_id, qid, d[1:greatest(1, least({_KEEP[_rule]}, 5, len(d)))] AS predicted FROM lists", f"cutoff_{_rule}")
    def _cutoff(spark, d, rule=_rule):
        return cutoff.apply_cutoff(v.all_runs(spark, d), rule, _VALUES[rule], keys=("run_id", "qid"))


SETTINGS = [*(("top_k", k) for k in range(1, 6)), *(("ratio", a / 100) for a in (60, 65, 70, 75, 80, 85, 90, 95, 99)), ("gap", None)]
_SWEPT = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, {x or 0}::DOUBLE AS value, qid, d[1:greatest(1, least({keep}, 5, len(d)))] AS predicted FROM lists"
    for r, x in SETTINGS
    for keep in [str(x) if r == "top_k" else _KEEP["gap"] if r == "gap" else f"CASE WHEN s[1] <= 0 THEN 10 ELSE len(list_filter(s, lambda x: x >= {x}::DOUBLE * s[1])) END"]
)


@query(
    with_sql("gold", "run_bm25", lists=_LISTS, swept=_SWEPT, rel="SELECT qid, list(doc_id) AS gold FROM gold GROUP BY qid")
    + f"SELECT rule, value, {R6(f'sum(coalesce(len(list_intersect(predicted, gold))::DOUBLE / len(gold), 0)) / {_N}')} AS recall, "
    f"{R6(f'sum(coalesce(len(list_intersect(predicted, gold)), 0)::DOUBLE / len(predicted)) / {_N}')} AS precision FROM swept LEFT JOIN rel USING (qid) GROUP BY rule, value"
)
def cutoff_sweep(spark, d):
    swept = cutoff.sweep(v.run(spark, d), SETTINGS)
    rel = v.gold(spark, d).groupBy("qid").agg(F.collect_set("doc_id").alias("gold"))
    n = v.questions(spark, d).count()
    hit = F.size(F.array_intersect("predicted", F.coalesce("gold", F.array().cast("array<string>"))))
    rows = swept.join(rel, "qid", "left").select("rule", "value", hit.alias("h"), F.size("predicted").alias("p"), F.size(F.coalesce("gold", F.array().cast("array<string>"))).alias("g"))
    return rows.groupBy("rule", "value").agg(
        F.round(F.sum(F.coalesce(F.try_divide("h", "g"), F.lit(0.0))) / n, 6).alias("recall"), F.round(F.sum(F.col("h") / F.col("p")) / n, 6).alias("precision")
    )


_CAND = "SELECT r.qid, r.doc_id, r.rank FROM run_bm25 r ANTI JOIN gold g ON r.qid = g.qid AND r.doc_id = g.doc_id WHERE rank > 2 AND rank <= 50"

# --- analysis

_DIAGNOSIS = {
    "g": "SELECT qid, count(*) AS n_gold, list(gold.doc_id) AS gold, count(rank) AS r, count(*) FILTER (WHERE rank <= 5) AS t, count(*) FILTER (WHERE c.doc_id IS NULL) AS gm FROM gold LEFT JOIN {run} USING (qid, doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM corpus) c ON c.doc_id = gold.doc_id GROUP BY qid",
    "u": "SELECT q.qid, coalesce(n_gold, 0) AS n_gold, coalesce(r, 0) AS r0, coalesce(t, 0) AS t0, coalesce(gm, 0) AS gm, coalesce(len(predicted), 0) AS n_pred, coalesce(predicted, []) AS p, coalesce(gold, []) AS gold FROM dev q LEFT JOIN g USING (qid) LEFT JOIN {pred} USING (qid)",
    "x": "SELECT *, len(list_intersect(list_distinct(p), gold)) AS a, CASE WHEN n_pred = 0 THEN 'zeroed_empty' WHEN n_pred > 5 THEN 'zeroed_over_cap' ELSE 'ok' END AS state FROM u",
    "y": "SELECT *, greatest(t0, a) AS t FROM x",
    "z": "SELECT *, greatest(least(r0, 5), t) AS r FROM y",
    "zz": "SELECT *, greatest(least(n_gold, 5), r) AS c FROM z",
    "dg": "SELECT qid, n_gold, n_pred, a AS n_hit_raw, state, gm, p, a > t0 AS prefix_violation, "
    + ", ".join(
        f"round(coalesce(({e})::DOUBLE / nullif(n_gold, 0), 0), 6) AS {n}"
        for n, e in (("recall", "CASE WHEN state = 'ok' THEN a ELSE 0 END"), ("loss_cap", "n_gold - c"), ("loss_retrieval", "c - r"), ("loss_ranking", "r - t"), ("loss_cutoff", "t - a"), ("loss_zeroed", "CASE WHEN state = 'ok' THEN 0 ELSE a END"))
    )
    + ", round(CASE WHEN state = 'ok' THEN coalesce(a::DOUBLE / nullif(n_pred, 0), 0) ELSE 0 END, 6) AS precision, greatest(0, 5 - n_pred) AS slots_free FROM zz",
}
_L = ", ".join(analysis.LOSSES)


def _diag_sql(kind: str = "bm25", more: tuple[str, ...] = (), **extra: str) -> str:
    parts = {k: s.format(run=f"run_{kind}", pred=f"pred_{kind}") if k in "gu" else s for k, s in _DIAGNOSIS.items()}
    return with_sql("corpus", "gold", f"run_{kind}", f"pred_{kind}", *more, **parts, **extra)


def _diagnosed(spark: SparkSession, d: str, kind: str = "bm25") -> DataFrame:
    return analysis.diagnose(v.questions(spark, d), v.gold(spark, d), v.run(spark, d, kind), v.predictions(spark, d, kind), v.corpus(spark, d))


@query(_diag_sql() + f"SELECT qid, n_gold, n_pred, n_hit_raw, state, recall, precision, {_L}, prefix_violation, slots_free FROM dg")
def loss_attribution(spark, d):
    return _diagnosed(spark, d).select("qid", "n_gold", "n_pred", "n_hit_raw", "state", "recall", "precision", *analysis.LOSSES, "prefix_violation", "slots_free")


_MEANS = ", ".join(f"{R6(f'avg({c})')} AS {c}" for c in ("recall", "precision", *analysis.LOSSES))
_COUNTS = (
    f"{R6('avg(slots_free)')} AS avg_slots_free, count(*) FILTER (WHERE recall >= 1) AS n_perfect, count(*) FILTER (WHERE recall <= 0) AS n_zero, "
    "count(*) FILTER (WHERE state = 'zeroed_over_cap') AS n_zeroed_over_cap, count(*) FILTER (WHERE state = 'zeroed_empty') AS n_zeroed_empty, "
    "count(*) FILTER (WHERE prefix_violation) AS n_prefix_violation, count(*) FILTER (WHERE gm > 0) AS n_gold_missing_corpus"
)
_KEPT = ("n_queries", "recall", "precision", *analysis.LOSSES, "avg_slots_free", "n_perfect", "n_zero", "n_zeroed_over_cap", "n_zeroed_empty", "n_prefix_violation", "n_gold_missing_corpus")


@query(_diag_sql() + f"SELECT count(*) AS n_queries, {_MEANS}, {_COUNTS} FROM dg")
def loss_aggregate(spark, d):
    return analysis.aggregate(_diagnosed(spark, d)).select(*_KEPT)


@query(_diag_sql() + f"SELECT n_gold, count(*) AS n_queries, {_MEANS}, {_COUNTS} FROM dg GROUP BY n_gold")
def segment_by_gold(spark, d):
    return analysis.aggregate(_diagnosed(spark, d), ["n_gold"]).select("n_gold", *_KEPT)


@query(_diag_sql() + f"SELECT source, count(*) AS n_queries, {_MEANS} FROM dg JOIN dev USING (qid) GROUP BY source")
def segment_by_source(spark, d):
    rows = _diagnosed(spark, d).join(v.questions(spark, d).select("qid", "source"), "qid")
    return analysis.aggregate(rows, ["source"]).select("source", "n_queries", "recall", "precision", *analysis.LOSSES)


@query(
    with_sql("gold", "run_bm25")
    + "SELECT CASE WHEN rank IS NULL THEN 'not retrieved' WHEN rank = 1 THEN '1' WHEN rank <= 5 THEN '2-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 25 THEN '11-25' WHEN rank <= 50 THEN '26-50' WHEN rank <= 100 THEN '51-100' ELSE '>100' END AS bucket, count(*) AS n FROM gold LEFT JOIN run_bm25 USING (qid, doc_id) GROUP BY 1"
)
def rank_buckets(spark, d):
    rows = v.gold(spark, d).join(v.run(spark, d), ["qid", "doc_id"], "left")
    return rows.groupBy(analysis.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    _diag_sql()
    + f"SELECT CASE WHEN w <= 10 THEN '1-10' WHEN w <= 20 THEN '11-20' WHEN w <= 40 THEN '21-40' ELSE '>40' END AS bucket, count(*) AS n, {R6('avg(recall)')} AS recall FROM (SELECT recall, len({tx.words_sql('text')}) AS w FROM dg JOIN dev USING (qid)) GROUP BY 1"
)
def length_buckets(spark, d):
    rows = _diagnosed(spark, d).join(v.questions(spark, d).select("qid", "text"), "qid")
    return rows.groupBy(analysis.length_bucket(tx.word_count(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"))


@query(
    with_sql("gold", "pred_bm25", "pred_dense", sa=_SCORES.format("pred_bm25"), sb=_SCORES.format("pred_dense"), j="SELECT qid, coalesce(b.hit::DOUBLE / nullif(b.n_gold, 0), 0) - coalesce(a.hit::DOUBLE / nullif(a.n_gold, 0), 0) AS dr FROM sa a FULL JOIN sb b USING (qid)")
    + "SELECT qid, round(dr, 6) AS d_recall, CASE WHEN round(dr, 6) > 0 THEN 'improved' WHEN round(dr, 6) < 0 THEN 'regressed' ELSE 'same' END AS change FROM j"
)
def run_compare(spark, d):
    return analysis.compare_runs(_diagnosed(spark, d, "bm25"), _diagnosed(spark, d, "dense")).select("qid", "d_recall", "change")


@query(
    _diag_sql()
    + f"SELECT qid, recall, CASE WHEN greatest({_L}) <= 0 THEN NULL " + " ".join(f"WHEN {c} = greatest({_L}) THEN '{c}'" for c in analysis.LOSSES)
    + f" END AS dominant, {_L} FROM dg ORDER BY recall, loss_cutoff DESC, qid LIMIT 30"
)
def worst_questions(spark, d):
    """A report: the limit is the feature."""
    return analysis.worst(_diagnosed(spark, d), 30)


@query(with_sql("corpus", "gold") + "SELECT qid, doc_id FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM corpus)")
def dangling_gold(spark, d):
    return analysis.dangling_gold(v.gold(spark, d), v.corpus(spark, d))


@query(
    with_sql("corpus", "gold")
    + f"SELECT qid FROM gold LEFT JOIN (SELECT DISTINCT doc_id, 1 AS ok FROM corpus WHERE regexp_replace(coalesce(text, ''), '{tx._SPACE}+', '', 'g') <> '') USING (doc_id) GROUP BY qid HAVING count(ok) = 0"
)
def unreachable_questions(spark, d):
    return analysis.unreachable(v.gold(spark, d), v.corpus(spark, d))


@query(
    with_sql("corpus", "dev", "gold", raw="SELECT DISTINCT qid, id AS doc_id FROM (SELECT qid, unnest(relevant) AS id FROM dev) WHERE id IS NOT NULL")
    + "SELECT 'FAIL' AS level, 'dangling_gold' AS check, count(*) AS n FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM corpus) "
    "UNION ALL SELECT 'FAIL', 'empty_questions', count(*) FROM dev WHERE trim(coalesce(text, '')) = '' "
    "UNION ALL SELECT 'FAIL', 'repeated_documents', count(*) FROM (SELECT doc_id FROM corpus GROUP BY doc_id HAVING count(*) > 1) "
    "UNION ALL SELECT 'WARN', 'empty_documents', count(*) FROM corpus WHERE trim(coalesce(text, '')) = '' "
    f"UNION ALL SELECT 'WARN', 'unreachable_questions', count(*) FROM (SELECT qid FROM raw LEFT JOIN (SELECT DISTINCT doc_id, 1 AS ok FROM corpus WHERE regexp_replace(coalesce(text, ''), '{tx._SPACE}+', '', 'g') <> '') USING (doc_id) GROUP BY qid HAVING count(ok) = 0)"
)
def validation_report(spark, d):
    return files.validate(v.corpus(spark, d), v.questions(spark, d))


@query()
def data_facts(spark, d):
    return pipelines.data_facts(v.documents(spark, d), v.questions(spark, d), v.questions(spark, d, "queries_train"))


@query(
    with_sql(
        "docs", "dev", "gold", articled=_ARTICLES, pieces=_PIECES, labelled=_LABELLED, chunks=_CHUNKS, **v._bm25_sql("chunks"),
        whole="SELECT qid, parent_id AS doc_id, round(max(score), 9) AS score FROM found JOIN chunks USING (doc_id) GROUP BY ALL",
        cut="SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM whole QUALIFY rank <= 5",
        pred_cut="SELECT qid, list(doc_id ORDER BY rank) AS predicted FROM cut GROUP BY qid",
        scores=_SCORES.format("pred_cut"), each_scored=_SUMS, s=_SET,
    )
    + _SET_COLUMNS
)
def retrieve_and_score(spark, d):
    """Articles of whole documents, ranked, collapsed, cut and scored."""
    return pipelines.retrieve_and_score(v.documents(spark, d).select("doc_id", "text", "title"), v.questions(spark, d), "article", digits=6)[2]


@query(
    with_sql(
        "gold", "run_dense", "run_bm25", ws="SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8]::DOUBLE[]) AS w_dense",
        cells="SELECT w_dense, qid, doc_id, round(sum(x), 9) AS score FROM (SELECT w_dense, qid, doc_id, w_dense / (60 + rank) AS x FROM run_dense, ws UNION ALL SELECT w_dense, qid, doc_id, (1 - w_dense) / (60 + rank) FROM run_bm25, ws) GROUP BY ALL",
        placed="SELECT *, CAST(row_number() OVER (PARTITION BY w_dense, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cells QUALIFY rank <= 100",
    ).rstrip() + ", " + _rank_sql("placed", _ranks((10, 100)), "w_dense")
)
def hybrid_sweep(spark, d):
    return pipelines.hybrid(v.run(spark, d, "dense"), v.run(spark, d, "bm25"), v.questions(spark, d), digits=9)


@query(
    with_sql(
        "corpus", "dev", "gold", "run_bm25", cand=_CAND, neg="SELECT qid, list(doc_id ORDER BY rank)[1:8] AS negative_ids FROM cand GROUP BY qid",
        own="SELECT qid, gold.doc_id AS positive_id, negative_ids, dev.text AS query, coalesce(c.text, '') AS positive FROM gold JOIN neg USING (qid) JOIN dev USING (qid) JOIN corpus c ON c.doc_id = gold.doc_id",
        e="SELECT qid, positive_id, unnest(negative_ids) AS doc_id, generate_subscripts(negative_ids, 1) AS pos FROM own",
        n="SELECT qid, positive_id, list(coalesce(text, '') ORDER BY pos) AS negatives FROM e LEFT JOIN corpus USING (doc_id) GROUP BY qid, positive_id",
    )
    + "SELECT qid, query, positive_id, positive, negative_ids, negatives FROM own JOIN n USING (qid, positive_id)"
)
def training_rows(spark, d):
    return pipelines.training_rows(v.run(spark, d), v.questions(spark, d), v.corpus(spark, d))


# --- ceilings


@query(
    with_sql("gold", "run_bm25").rstrip() + ", "
    + _rank_sql("run_bm25", "").replace(" SELECT  FROM each", "")
    + ", t AS (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k, unnest([" + ", ".join(f"sum(h{k}::DOUBLE / g) / {_N}" for k in (1, 5, 10, 20, 50, 100)) + "]) AS r FROM each)"
    + " SELECT CAST(k AS INTEGER) AS k, round(r, 6) AS recall, round(round(r, 6) - lag(round(r, 6), 1, 0.0::DOUBLE) OVER (ORDER BY k), 6) AS gain FROM t"
)
def ceiling_table(spark, d):
    ks = (1, 5, 10, 20, 50, 100)
    row = metrics.rank_metrics(v.questions(spark, d), v.gold(spark, d), v.run(spark, d), ks)
    long = row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in ks))))
    return fusion.ceiling_table(long)


@query(
    with_sql(
        "gold", "run_bm25", "run_cross", **_RERANK, gs="SELECT qid, count(*) AS g FROM gold GROUP BY qid",
        c="SELECT sum(h::DOUBLE / g) AS c FROM (SELECT qid, count(*) FILTER (WHERE rank <= 50) AS h FROM run_bm25 JOIN gold USING (qid, doc_id) GROUP BY qid) JOIN gs USING (qid)",
        a="SELECT sum(h::DOUBLE / g) AS a FROM (SELECT qid, count(*) FILTER (WHERE rank <= 5) AS h FROM again JOIN gold USING (qid, doc_id) GROUP BY qid) JOIN gs USING (qid)",
        r=f"SELECT {R6(f'c / {_N}')} AS ceiling, {R6(f'a / {_N}')} AS achieved FROM c, a",
    )
    + "SELECT ceiling, achieved, CASE WHEN ceiling < 0.80 THEN 'RETRIEVER' WHEN ceiling - achieved > 0.10 THEN 'RERANKER' ELSE 'RETRIEVER/stop' END AS verdict FROM r"
)
def ceiling_verdict(spark, d):
    base = metrics.rank_metrics(v.questions(spark, d), v.gold(spark, d), v.run(spark, d), (50,)).select(F.col("recall_50").alias("ceiling"))
    made = metrics.rank_metrics(v.questions(spark, d), v.gold(spark, d), _reranked(spark, d), (5,)).select(F.col("recall_5").alias("achieved"))
    return base.crossJoin(F.broadcast(made)).withColumn("verdict", fusion.ceiling_verdict(F.col("ceiling"), F.col("achieved")))  # one row each


# --- text generation


def _rouge_sql(n: int) -> str:
    grams = lambda t: t if n == 1 else f"list_transform(range(1, greatest(len({t}), 1)), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return (
        with_sql(
            "qa",
            tk=f"SELECT qid, {tx.rouge_tokens_sql('answer')} AS a, {tx.rouge_tokens_sql('text')} AS q FROM qa",
            gr=f"SELECT qid, {grams('a')} AS t, {grams('q')} AS p FROM tk",
            tc="SELECT qid, g, count(*) AS n FROM (SELECT qid, unnest(t) AS g FROM gr) GROUP BY ALL",
            pc="SELECT qid, g, count(*) AS n FROM (SELECT qid, unnest(p) AS g FROM gr) GROUP BY ALL",
            h="SELECT qid, sum(least(tc.n, pc.n)) AS h FROM tc JOIN pc USING (qid, g) GROUP BY qid",
            s="SELECT qid, coalesce(h, 0)::DOUBLE / greatest(len(p), 1) AS p, coalesce(h, 0)::DOUBLE / greatest(len(t), 1) AS r FROM gr LEFT JOIN h USING (qid)",
        )
        + "SELECT qid, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS fmeasure FROM s"
    )


for _n in (1, 2):

    @query(_rouge_sql(_n), f"rouge_{_n}")
    def _rouge(spark, d, n=_n):
        return textgen.rouge_n(v.answers(spark, d), "qid", "answer", "text", n)


@query()
def rouge_l(spark, d):
    return textgen.rouge_l(v.answers(spark, d), "qid", "answer", "text")


@query()
def rouge_lsum(spark, d):
    return textgen.rouge_lsum(v.answers(spark, d), "qid", "answer", "text")


@query()
def meteor(spark, d):
    return textgen.meteor(v.answers(spark, d), "qid", "answer", "text")


@query()
def bootstrap_interval(spark, d):
    return textgen.bootstrap(textgen.rouge_l(v.answers(spark, d), "qid", "answer", "text"), "qid", "fmeasure")


@query()
def eval_qa(spark, d):
    gold = v.answers(spark, d)
    return textgen.eval_qa(gold.select("qid", "answer"), gold.select("qid", F.col("text").alias("answer")))


# --- data sets

_STRATA = {"sized": "SELECT qid, least(count(doc_id), 5) AS stratum FROM train LEFT JOIN train_gold USING (qid) GROUP BY qid"}
_BLANK = f"SELECT doc_id FROM corpus GROUP BY doc_id HAVING max(CASE WHEN regexp_replace(coalesce(text, ''), '{tx._SPACE}+', '', 'g') <> '' THEN 1 ELSE 0 END) = 0"
_SPLIT = {
    # Questions whose gold is all in the corpus and blank leave before the strata are sized.
    "quarantine": f"SELECT qid FROM train_gold GROUP BY qid HAVING count(*) = count(*) FILTER (WHERE doc_id IN ({_BLANK}))",
    "sized": "SELECT qid, least(count(doc_id), 5) AS stratum FROM train LEFT JOIN train_gold USING (qid) WHERE qid NOT IN (SELECT qid FROM quarantine) GROUP BY qid",
    "p": "SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || qid), qid) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM sized",
    "sp": "SELECT qid, stratum, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.15, 0)) ELSE 0 END THEN 'dev' ELSE 'train' END AS split FROM p",
}


def _split(spark: SparkSession, d: str) -> DataFrame:
    """Of the questions that can be answered: the quarantined ones leave before the strata are sized."""
    gold = v.gold(spark, d, "queries_train")
    sizes = gold.groupBy("qid").agg(F.count("*").alias("g"))
    rows = v.questions(spark, d, "queries_train").select("qid").join(analysis.quarantined(gold, v.corpus(spark, d)), "qid", "left_anti").join(sizes, "qid", "left")
    return dataset.stratified_split(rows.select("qid", F.least(F.coalesce("g", F.lit(0)), F.lit(5)).alias("stratum")), "qid", "stratum")


@query(with_sql("train", "train_gold", "corpus", **_SPLIT) + "SELECT qid, stratum, split FROM sp")
def dev_split(spark, d):
    return _split(spark, d)


@query(
    with_sql("train", "train_gold", "corpus", **_SPLIT)
    + f"SELECT stratum, count(*) AS n_all, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'dev') AS n_dev, {R6('''100 * avg(CASE WHEN split = 'dev' THEN 1 ELSE 0 END)''')} AS dev_percent FROM sp GROUP BY stratum"
)
def dev_split_report(spark, d):
    return dataset.split_report(_split(spark, d), "stratum")


@query(
    with_sql("corpus", n=f"SELECT len({tx.words_sql('text')}) AS n FROM corpus")
    + f"SELECT count(*) AS n, {R6('avg(n)')} AS mean, {INT('min(n)')} AS min, {INT('max(n)')} AS max, "
    + ", ".join(f"{INT(f'list_sort(list(n))[least(CAST(floor({p} * count(*)) AS BIGINT), count(*) - 1) + 1]')} AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))
    + " FROM n"
)
def length_profile(spark, d):
    return dataset.describe(v.corpus(spark, d).select(tx.word_count(F.col("text")).alias("w")), "w").select("n", "mean", "min", "max", "p50", "p90", "p95", "p99")


@query(
    with_sql("train", "train_gold", **_STRATA, c="SELECT n AS n_gold, count(*) AS n FROM (SELECT qid, count(doc_id) AS n FROM train LEFT JOIN train_gold USING (qid) GROUP BY qid) GROUP BY 1")
    + f"SELECT n_gold, n, {R6('n / sum(n) OVER ()')} AS share, {R6('sum(n) OVER (ORDER BY n_gold) / sum(n) OVER ()')} AS cumulative FROM c"
)
def gold_histogram(spark, d):
    return dataset.gold_histogram(v.gold(spark, d, "queries_train"), v.questions(spark, d, "queries_train"))


@query(
    with_sql("corpus", "gold", "run_bm25", cand=_CAND, neg="SELECT qid, list(doc_id ORDER BY rank)[1:8] AS negative_ids FROM cand GROUP BY qid")
    + "SELECT qid, doc_id AS positive_id, negative_ids FROM gold JOIN neg USING (qid) WHERE doc_id IN (SELECT doc_id FROM corpus)"
)
def hard_negatives(spark, d):
    return dataset.hard_negatives(v.run(spark, d), v.gold(spark, d), v.corpus(spark, d))


@query(
    with_sql("corpus", "gold", "run_bm25", cand=_CAND, neg="SELECT qid, list(doc_id ORDER BY rank)[1:4] AS negative_ids FROM cand GROUP BY qid")
    + "SELECT qid, doc_id AS positive_id, negative_ids FROM gold JOIN neg USING (qid) WHERE doc_id IN (SELECT doc_id FROM corpus) AND len(negative_ids) >= 4"
)
def biencoder_rows(spark, d):
    return dataset.exact_negatives(dataset.hard_negatives(v.run(spark, d), v.gold(spark, d), v.corpus(spark, d)), 4)


@query(with_sql("corpus", "gold") + "SELECT qid, doc_id AS positive_id FROM gold WHERE doc_id IN (SELECT doc_id FROM corpus)")
def positive_pairs(spark, d):
    return dataset.positive_pairs(v.gold(spark, d), v.corpus(spark, d))


@query(
    with_sql(
        "corpus", "gold", "run_bm25", cand=_CAND, gs="SELECT qid, count(*) AS g FROM gold GROUP BY qid",
        drawn="SELECT qid, doc_id, g, row_number() OVER (PARTITION BY qid ORDER BY md5('42:' || qid || ':' || doc_id), doc_id) AS r FROM cand JOIN gs USING (qid) WHERE doc_id IN (SELECT doc_id FROM corpus)",
    )
    + "SELECT qid, doc_id, 1 AS label FROM gold WHERE doc_id IN (SELECT doc_id FROM corpus) UNION ALL SELECT qid, doc_id, 0 FROM drawn WHERE r <= 4 * g"
)
def cross_encoder_rows(spark, d):
    return dataset.cross_encoder_pairs(v.run(spark, d), v.gold(spark, d), v.corpus(spark, d))


# --- question answering

_CTX = "SELECT qid, list(doc_id ORDER BY rank) AS context_ids, list(coalesce(text, '') ORDER BY rank) AS passages FROM run_bm25 LEFT JOIN corpus USING (doc_id) WHERE rank <= 3 GROUP BY qid"


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    return qa.contexts(v.run(spark, d), v.corpus(spark, d))


@query(with_sql("corpus", "run_bm25", ctx=_CTX) + "SELECT qid, context_ids, array_to_string(passages, ' ') AS answer FROM ctx")
def extractive_answers(spark, d):
    return qa.extractive_answers(_contexts(spark, d))


@query(
    with_sql(
        "corpus", "dev", "run_bm25", ctx=_CTX,
        num="SELECT qid, array_to_string(list_transform(range(1, len(passages) + 1), lambda i: '[' || i || '] (' || context_ids[i] || ') ' || CASE WHEN length(passages[i]) > 1500 THEN substr(passages[i], 1, 1500) || ' …' ELSE passages[i] END), chr(10) || chr(10)) AS c FROM ctx",
    )
    + "SELECT qid, 'Các đoạn văn bản pháp luật:' || chr(10) || c || chr(10) || chr(10) || 'Câu hỏi: ' || coalesce(text, '') || chr(10) || 'Trả lời:' AS prompt FROM num JOIN dev USING (qid)"
)
def prompt_build(spark, d):
    return qa.prompts(v.questions(spark, d), _contexts(spark, d), "minimal")


@query(
    with_sql(
        "corpus", "dev", "gold", "run_bm25", ctx=_CTX, ans="SELECT qid, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS answer FROM gold LEFT JOIN corpus USING (doc_id) GROUP BY qid",
        n=f"SELECT {tx.normalize_sql('answer')} AS a, {tx.normalize_sql('''array_to_string(passages, ' ')''')} AS c FROM ans LEFT JOIN ctx USING (qid)",
        h="SELECT CASE WHEN a <> '' AND contains(c, a) THEN 1 ELSE 0 END AS h FROM n",
    )
    + f"SELECT count(*) AS n, count(*) FILTER (WHERE h = 1) AS contained, {R6('avg(h)')} AS share FROM h"
)
def oracle_ceiling(spark, d):
    """How often the text of a question's gold documents stands within its context."""
    named = v.gold(spark, d).join(v.corpus(spark, d).select("doc_id", "text"), "doc_id", "left")
    items = F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t"))))
    wanted = named.groupBy("qid").agg(F.array_join(F.transform(items, lambda x: x["t"]), " ").alias("answer"))
    return qa.oracle_ceiling(wanted, _contexts(spark, d))


@query(
    with_sql("qa", n=f"SELECT avg(len({tx.words_sql('answer')})) AS g, avg(len({tx.words_sql('text')})) AS p FROM qa")
    + f"SELECT {R6('g')} AS gold_words, {R6('p')} AS pred_words, {R6('p / g')} AS ratio, CASE WHEN p / g < 0.6 THEN 'short' WHEN p / g > 2 THEN 'long' ELSE 'ok' END AS flag FROM n"
)
def length_ratio(spark, d):
    gold = v.answers(spark, d)
    return qa.length_report(gold.select("answer"), gold.select(F.col("text").alias("answer")))


# --- runs, nesting, streams

_LOG = [("a", "0.51", "0.48"), ("b", "0.62", "0.59"), ("c", "0.70", "0.71"), ("d", "0.66", "0.73"), ("e", "", "0.2"), ("f", "x", "0.1")]


@query(
    "WITH l AS (SELECT * FROM (VALUES ('a', 0.51::DOUBLE, 0.48::DOUBLE), ('b', 0.62, 0.59), ('c', 0.70, 0.71), ('d', 0.66, 0.73)) t(run_id, x, y)), "
    "r AS (SELECT *, row_number() OVER (ORDER BY x, run_id) AS rx, row_number() OVER (ORDER BY y, run_id) AS ry FROM l) "
    f"SELECT count(*) AS n, {R6('corr(x, y)')} AS pearson, {R6('corr(rx, ry)')} AS spearman, CASE WHEN corr(rx, ry) >= 0.8 THEN 'healthy' WHEN corr(rx, ry) >= 0.5 THEN 'suspect' ELSE 'broken' END AS verdict FROM r"
)
def log_correlation(spark, d):
    return runs.correlation(spark.createDataFrame(_LOG, "run_id string, dev_official string, leaderboard string"))


@query(with_sql("all_runs") + "SELECT run_id, qid, list(doc_id ORDER BY rank) AS ids FROM all_runs GROUP BY run_id, qid")
def nest_run(spark, d):
    nested = rankings.nest_run(v.all_runs(spark, d), ["run_id", "qid"])
    return nested.select("run_id", "qid", F.transform("ranked", lambda x: x["doc_id"]).alias("ids"))


@query(with_sql("all_pred") + "SELECT run_id, qid, unnest(predicted) AS doc_id, CAST(generate_subscripts(predicted, 1) AS INTEGER) AS pos FROM all_pred")
def unnest_predictions(spark, d):
    return rankings.unnest_predictions(v.all_predictions(spark, d), ["run_id", "qid"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return windowed_counts(v.table(spark, d, "events"), "ts", "event_type", "value")
