"""Uses and documents of every distinct term, with marks for too rare and too common ones.

Heavy terms, found on a hash sample of the documents, are broadcast and counted exactly in
local arrays of each task; only the other terms are shuffled, already summed per task.
Which terms count as heavy changes the cost, never the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.textform import canonical_batches
from quillet.session import cut

#: Heavy terms at most; each costs two counters per task.
MAX_HEAVY = 4096
#: One document in so many is looked at to find the heavy terms, and of these the share that must hold one.
SAMPLE, HEAVY_SHARE = 16, 0.02
#: Keys with several rows that are broadcast; with more they are joined.
SMALL = 100_000
#: Distinct light terms that a task sums before it sends them on.
FLUSH = 200_000

TERMS = re.compile(r"[^\W_]+").findall


def terms(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return TERMS(text.lower())


def _count(heavy: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(heavy)}
        uses, docs = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        light_uses: Counter[str] = Counter()
        light_docs: Counter[str] = Counter()
        holding = 0

        def table(kind: int, names: list, n: list, d: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                names=["kind", "term", "uses", "docs"],
            )

        for batch in canonical_batches("text", "text")(batches):
            for text in batch.column("text").to_pylist():
                own = Counter(terms(text)) if text else None
                if not own:
                    continue
                holding += 1
                for t, n in own.items():
                    i = place.get(t)
                    if i is None:
                        light_uses[t] += n
                        light_docs[t] += 1
                    else:
                        uses[i] += n
                        docs[i] += 1
            if len(light_uses) > FLUSH:
                yield table(1, list(light_uses), list(light_uses.values()), [light_docs[t] for t in light_uses])
                light_uses.clear()
                light_docs.clear()
        if light_uses:
            yield table(1, list(light_uses), list(light_uses.values()), [light_docs[t] for t in light_uses])
        seen = np.flatnonzero(docs)
        yield table(0, [heavy[i] for i in seen], uses[seen].tolist(), docs[seen].tolist())
        yield table(2, [""], [0], [holding])

    return run


SCHEMA = "kind int, term string, uses bigint, docs bigint"


def _once(rows: DataFrame, key: str, column: str, version: str | None) -> DataFrame:
    """(``key``, ``text``), each key once; only the texts of keys with several rows are shuffled."""
    order = F.struct(F.col(version), F.col(column)) if version else F.col(column)
    several = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_several")))
    known = F.broadcast(several) if several.limit(SMALL + 1).count() <= SMALL else several
    marked = rows.join(known, F.col(key) == F.col("_several"), "left")
    best = marked.filter("_several is not null").groupBy(key).agg(F.max_by(F.col(column), order).alias("text"))
    return marked.filter("_several is null").select(key, F.col(column).alias("text")).unionByName(best)


def term_counts(df: DataFrame, key: str, column: str, version: str | None = None) -> tuple[DataFrame, int]:
    """Rows (``term``, ``uses``, ``docs``) and the number of documents that hold a term.

    Each key counts once: with the text of the greatest ``version``, the greatest text
    among equal ones. Null keys, null texts and texts without terms hold none. An empty
    table gives no rows and 0. Whole texts and all documents are counted.
    """
    texts = _once(df.filter(F.col(key).isNotNull() & F.col(column).isNotNull()), key, column, version)
    sample = texts.filter(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0).select("text")
    found = cut(sample.mapInArrow(_count([]), SCHEMA))
    looked = found.filter("kind = 2").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    heavy = [
        r["term"]
        for r in found.filter("kind = 1")
        .groupBy("term")
        .agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= max(2, HEAVY_SHARE * looked))
        .orderBy(F.col("docs").desc(), "term")
        .limit(MAX_HEAVY)
        .collect()
    ]
    parts = cut(texts.select("text").mapInArrow(_count(heavy), SCHEMA))
    holding = parts.filter("kind = 2").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]

    def summed(kind: int) -> DataFrame:
        return (
            parts.filter(F.col("kind") == kind)
            .groupBy("term")
            .agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
        )

    return summed(0).unionByName(summed(1)), int(holding)


def marked_terms(
    df: DataFrame, key: str, column: str, version: str | None = None, rare: int = 2, common: float = 0.5
) -> DataFrame:
    """term_counts with ``mark``: ``rare`` in at most ``rare`` documents, else ``common`` in
    more than the share ``common`` of the documents that hold a term, else null."""
    counts, holding = term_counts(df, key, column, version)
    return counts.withColumn(
        "mark",
        F.when(F.col("docs") <= rare, F.lit("rare")).when(F.col("docs") > F.lit(common * holding), F.lit("common")),
    )
