"""Documents into articles, clauses and word windows, and rankings of parts back to wholes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import stripped, word_count, words
from quillet.sources.rankings import ranked

# How articles, clauses and points begin; (?iumd): case and lines as in Unicode, \n only.
ARTICLE = r"^[ \t]*điều\s+(\d+)\s*[.\-:–]?"
CLAUSE = r"^[ \t]*(\d{1,2})\s*[.)]\s+"
POINT = r"^[ \t]*([a-zđ])\s*[)]\s+"


def split_on(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """A row per piece with ``pos``, ``label`` and ``piece``.

    Pieces begin where the pattern matches. Text before the first match has the label
    ``_preamble`` and is left out when blank; a text without a match is one piece, as it
    is, with the label ``_whole``. A null text is like an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = df.select("*", F.posexplode(F.split(t, f"(?iumd)(?={pattern})")).alias("pos", "_piece"))
    label = F.regexp_extract("_piece", f"(?iumd)\\A{pattern[1:]}", 1)
    whole = ~t.rlike(f"(?iumd){pattern}")
    return (
        parts.withColumn("label", F.when(whole, "_whole").when(label == "", "_preamble").otherwise(label))
        .withColumn("piece", F.when(whole, t).otherwise(stripped(F.col("_piece"))))
        .filter((F.col("label") != "_preamble") | (F.col("piece") != ""))
        .drop("_piece")
    )


def windows(text: Column, size: int = 256, stride: int = 192) -> Column:
    """Array of word windows; a text of at most ``size`` words is one window, unchanged."""
    w = words(text)
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(n - size + stride, F.lit(1)) - 1, F.lit(stride))
    return F.when(n <= size, F.array(text)).otherwise(
        F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    )


def build_corpus(
    docs: DataFrame, granularity: str = "document", window: int | None = None, stride: int = 192, min_chars: int = 30
) -> DataFrame:
    """(``doc_id``, ``text``, ``parent_id``, ``title``, ``granularity``) of (``doc_id``, ``text``, ``title``).

    A repeated id gets @1, @2 … in order, counted before pieces shorter than ``min_chars``
    are dropped. Articles and clauses carry the title before their text; windows add ::w0 ….
    """
    base = docs.select(F.col("doc_id").alias("parent_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("title", F.lit("")).alias("title"))
    if granularity == "document":
        parts = base.withColumn("doc_id", F.col("parent_id")).withColumn("piece", F.col("text")).withColumn("_n", F.lit(1))
    elif granularity in ("article", "clause"):
        parts = split_on(base, "text", ARTICLE).withColumn("doc_id", F.concat("parent_id", F.lit("#dieu"), "label"))
        order = [F.col("pos")]
        if granularity == "clause":
            parts = parts.drop("text", "label").withColumnsRenamed({"piece": "text", "pos": "_first"})
            parts = split_on(parts, "text", CLAUSE).withColumn("doc_id", F.concat("doc_id", F.lit("#khoan"), "label"))
            order = [F.col("_first"), F.col("pos")]
        parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("parent_id", "doc_id").orderBy(*order)))
    else:
        raise ValueError(f"granularity must be document, article or clause, not {granularity!r}")
    own = F.when(F.col("_n") > 1, F.concat("doc_id", F.lit("@"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("doc_id"))
    made = parts.withColumn("doc_id", own).withColumn("piece", stripped(F.col("piece"))).filter(F.length("piece") >= min_chars)
    body = F.col("piece")
    if granularity != "document":
        body = F.when(F.col("title") != "", F.concat("title", F.lit("\n"), "piece")).otherwise(body)
    made = made.select("doc_id", body.alias("text"), "parent_id", "title", F.lit(granularity).alias("granularity"))
    if window is None:
        return made
    return made.select("*", F.posexplode(windows(F.col("text"), window, stride)).alias("_w", "_t")).select(
        F.concat("doc_id", F.lit("::w"), F.col("_w").cast("string")).alias("doc_id"), F.col("_t").alias("text"), "parent_id", "title", "granularity"
    )


def aggregate_to_parent(run: DataFrame, parents: DataFrame, how: str = "max", top_k: int = 100) -> DataFrame:
    """A run of parts (``qid``, ``doc_id``, ``score``) as a run of wholes; an unknown part is its own whole."""
    merge = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]
    owned = run.join(parents.select("doc_id", "parent_id"), "doc_id", "left")
    merged = owned.groupBy("qid", F.coalesce("parent_id", "doc_id").alias("doc_id")).agg(F.round(merge("score"), 9).alias("score"))
    return ranked(merged, ["qid"], top_k)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: parts, wholes, and the mean, percentiles and maximum of their words."""
    from quillet.operators.dataset import percentiles

    return percentiles(
        corpus.select("parent_id", word_count(F.col("text")).alias("n")), "n", {"len_p50": 0.5, "len_p90": 0.9, "len_p99": 0.99},
        [F.count("*").alias("n_chunks"), F.countDistinct("parent_id").alias("n_parents"), F.round(F.avg("n"), 6).alias("len_mean"), F.max("n").alias("len_max")],
    )
