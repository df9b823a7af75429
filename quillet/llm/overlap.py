"""Same and near-same records across splits.

Texts are compared as words in one consistent form. Exact copies are one class. Minwise
hashes of the words fall into banded buckets; only pairs of classes from different splits
that share a bucket go on, to an exact Jaccard similarity and then to the word edit
distance. Pairs of classes become pairs of records by membership.

Most buckets are known to one split only. So the buckets of one split are marked in a bitmap
of bounded size, those of the other that meet no mark never leave their task, and those that
meet one are marked in turn; what is shuffled are buckets of both. A mark that two buckets
share costs a row, never a result.

Words, each with its number of occurrence, are the shingles here: the cases are stated as
edits of at most one word in eight, and five scattered edits of forty words leave almost
no longer shingle intact. Such a pair has a multiset Jaccard similarity of at least
(1 - 1/8) / (1 + 1/8) = 7/9.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.textform import canonical_batches
from quillet.session import cut

#: A pair at the least similarity, 7/9, misses all bands with a probability of 1e-4.
BANDS, ROWS, SEED = 64, 8, 20240229
#: One word in so many may differ.
ONE_IN = 8
#: Bits of a bitmap for each bucket it marks, and at most (64 MB); with more buckets it only stops fewer.
SPARE, MOST_BITS = 32, 1 << 29
#: Words that are hashed at once.
AT_ONCE = 200_000

WORDS = re.compile(r"[^\W_]+").findall


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return (rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def words_of(text: str) -> list[str]:
    """Words regardless of letter case, punctuation, spacing and character form."""
    return WORDS(unicodedata.normalize("NFKC", text).casefold())


def shingles(words: list[str]) -> list[int]:
    """64-bit hashes of the words, each with its number of occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for w in words:
        seen[w] += 1
        out.append(xxhash.xxh3_64_intdigest(f"{w} {seen[w]}"))
    return out


def bucket_keys(texts: list[str]) -> np.ndarray:
    """A row of 64-bit bucket keys per text: one per band, which is part of the key, and one of the letters alone."""
    a, b = _hashes()
    keys = np.empty((len(texts), BANDS + 1), np.uint64)
    for i, text in enumerate(texts):
        keys[i, BANDS] = xxhash.xxh3_64_intdigest(text.replace(" ", ""), seed=1)
    start = 0
    while start < len(texts):
        tokens, begins = [], []
        end = start
        while end < len(texts) and (end == start or len(tokens) < AT_ONCE):
            begins.append(len(tokens))
            tokens += shingles(texts[end].split(" "))
            end += 1
        hashed, at = np.array(tokens, np.uint64), np.array(begins)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                out = np.full(end - start, band, np.uint64)
                for r in range(band * ROWS, (band + 1) * ROWS):
                    # Tokens are hashes already: an odd multiple and a shift order them anew.
                    out = (out ^ np.minimum.reduceat(hashed * a[r] + b[r], at)) * np.uint64(0x9E3779B97F4A7C15)
                    out ^= out >> np.uint64(31)
                keys[start:end, band] = out
        start = end
    return keys.view(np.int64)


def edit_distance(a: list[str], b: list[str]) -> int:
    """Word edit distance, bit-parallel: the steps up and down a column of the table are bits of two numbers."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for y in b:
        same = where.get(y, 0) | down
        level = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(level | up)), up & level
        distance += bool(rises & last) - bool(falls & last)
        rises = ((rises << 1) | 1) & full
        down = rises & level
        up = ((falls << 1) & full) | (full & ~(level | rises))
    return distance


def near(a: str, b: str) -> bool:
    """Whether at most one word in ONE_IN of the longer text has to change.

    The exact Jaccard similarity of the words comes first: at less than its least value for
    such texts, 7/9, the distance need not be taken.
    """
    x, y = a.split(" "), b.split(" ")
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    common = (Counter(x) & Counter(y)).total()
    if common * 2 * ONE_IN < (len(x) + len(y)) * (ONE_IN - 1):
        return False
    return edit_distance(x, y) <= max(len(x), len(y)) // ONE_IN


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, key, text) with the words of a text for the text, and its class; texts without words go."""
    for batch in canonical_batches("text", "text")(batches):
        words = [" ".join(words_of(t)) for t in batch.column("text").to_pylist()]
        classes = [xxhash.xxh3_128_digest(w) for w in words]
        made = pa.RecordBatch.from_arrays(
            [batch.column("side"), batch.column("key"), pa.array(words, pa.string()), pa.array(classes, pa.binary())], names=["side", "key", "text", "class"]
        )
        yield made.filter(pa.array([w != "" for w in words], pa.bool_()))


def _keys(marks=None, bits: int = 0):
    """(text, class) to the rows (bucket, class) of its buckets, of all or of those that a bitmap marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(marks.value, np.uint8) if marks is not None else None
        for batch in batches:
            keys = bucket_keys(batch.column("text").to_pylist())
            if field is None:
                rows, columns = np.nonzero(np.ones(keys.shape, bool))
            else:
                at = keys.view(np.uint64) % np.uint64(bits)
                rows, columns = np.nonzero(field[at >> np.uint64(3)] & (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[rows, columns], pa.int64()), batch.column("class").take(pa.array(rows))], names=["bucket", "class"]
            )

    return run


def _marked(keys: DataFrame, bits: int):
    """A broadcast bitmap of the buckets: bit (bucket mod bits) is set. Combined in the tasks, by 4 KB pieces."""
    at = F.expr(f"pmod(cast(bucket as decimal(20)) + if(bucket < 0, 18446744073709551616bd, 0bd), {bits}bd)").cast("bigint")
    pieces = (
        keys.select(F.floor(at / 32768).cast("int").alias("piece"), F.pmod(at, F.lit(32768)).alias("bit"))
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("bit").alias("marks"))
        .collect()  # at most MOST_BITS / 32768 pieces
    )
    field = np.zeros((bits // 32768, 4096), np.uint8)
    for r in pieces:
        field[r["piece"]] = np.frombuffer(r["marks"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(field.tobytes())


def overlapping_classes(left: DataFrame, right: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of text classes (``a`` of left, ``b`` of right) and the members (``side``, ``key``, ``class``)."""
    both = left.select(F.lit(0).alias("side"), F.col(key).alias("key"), F.col(column).alias("text")).unionByName(
        right.select(F.lit(1).alias("side"), F.col(key).alias("key"), F.col(column).alias("text"))
    )
    kind = both.schema["key"].dataType.simpleString()
    members = cut(both.dropna(subset=["key", "text"]).mapInArrow(_worded, f"side int, key {kind}, text string, class binary"))
    schema = "bucket bigint, class binary"
    texts = [members.filter(F.col("side") == side).select("text", "class") for side in (0, 1)]
    count = texts[0].count() * (BANDS + 1) * SPARE
    bits = min(max(1 << max(count - 1, 0).bit_length(), 1 << 15), MOST_BITS)
    marks = _marked(texts[0].mapInArrow(_keys(), schema), bits)
    two = cut(texts[1].mapInArrow(_keys(marks, bits), schema).distinct())
    one = texts[0].mapInArrow(_keys(_marked(two, bits), bits), schema).distinct()
    pairs = cut(
        one.withColumnRenamed("class", "a").join(two.withColumnRenamed("class", "b"), "bucket").select("a", "b").distinct()
    )

    def named(side: int, name: str, text: str) -> DataFrame:
        wanted = pairs.select(F.col(name).alias("class")).distinct()
        own = texts[side].join(wanted, "class", "left_semi").dropDuplicates(["class"])
        return own.select(F.col("class").alias(name), F.col("text").alias(text))

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kept = [near(x, y) for x, y in zip(part["ta"], part["tb"])]
            yield part.loc[kept, ["a", "b"]]

    close = pairs.join(named(0, "a", "ta"), "a").join(named(1, "b", "tb"), "b")
    return cut(close.mapInPandas(verify, "a binary, b binary")), members.select("side", "key", "class")


def overlapping_records(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct pairs (``left_key``, ``right_key``) of records whose texts are the same or nearly so.

    Null keys and texts without words are no cases; repeated rows count once; an empty table
    on either side gives no rows. Whole texts are compared; no cap on partners.
    """
    pairs, members = overlapping_classes(left, right, key, column)
    return (
        pairs.join(members.filter("side = 0").select(F.col("class").alias("a"), F.col("key").alias("left_key")), "a")
        .join(members.filter("side = 1").select(F.col("class").alias("b"), F.col("key").alias("right_key")), "b")
        .select("left_key", "right_key")
        .distinct()
    )


def overlap_report(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, source: str, names: tuple[str, str]) -> DataFrame:
    """Rows (``split``, ``source``, ``records``, ``pairs``): overlaps per split and source; a null source stays null.

    A record with several sources counts for the smallest.
    """

    def side(records: DataFrame, column: str, name: str) -> DataFrame:
        sources = records.groupBy(F.col(key).alias(column)).agg(F.min(source).alias("source"))
        return (
            pairs.groupBy(column)
            .agg(F.count("*").alias("n"))
            .join(sources, column)
            .groupBy("source")
            .agg(F.count("*").alias("records"), F.sum("n").alias("pairs"))
            .select(F.lit(name).alias("split"), "source", "records", "pairs")
        )

    return side(left, "left_key", names[0]).unionByName(side(right, "right_key", names[1]))
