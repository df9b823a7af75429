"""Text-generation metrics: ROUGE, METEOR and bootstrap intervals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

VOWELS = "aeiou"
TOKENS = re.compile("[a-z0-9]+").findall


def f_measure(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _tokens(text: str | None, stems: bool = False) -> list[str]:
    """The metric's tokens, as rouge_tokens makes them; with ``stems`` those of more than three letters by their stem."""
    words = TOKENS((text or "").lower())
    return [stem(w) if len(w) > 3 else w for w in words] if stems else words


def _counts(hits: Callable[[str | None, str | None], tuple[int, int, int]]) -> Callable[..., Column]:
    """A column function of two texts: hits, size of the target, size of the prediction."""
    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in ("h", "t", "p")])

    @pandas_udf(kind)
    def made(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(x, y) for x, y in zip(a, b)], columns=["h", "t", "p"], dtype="int32")

    return made


def _scores(df: DataFrame, key: str, counts: Column) -> DataFrame:
    rows = df.select(key, counts.alias("_c"))
    ratio = lambda c: F.coalesce(F.try_divide("_c.h", c), F.lit(0.0))
    rows = rows.select(key, ratio("_c.p").alias("precision"), ratio("_c.t").alias("recall"))
    return rows.withColumn("fmeasure", F.round(f_measure(F.col("precision"), F.col("recall")), 6)).withColumns(
        {c: F.round(c, 6) for c in ("precision", "recall")}
    )


def rouge_n(df: DataFrame, key: str, target: str, prediction: str, n: int = 1, stems: bool = False) -> DataFrame:
    """(``key``, ``precision``, ``recall``, ``fmeasure``): clipped overlap of n-grams.

    The multisets are counted per Arrow batch; texts are neither exploded nor shuffled.
    """

    def hits(a: str | None, b: str | None) -> tuple[int, int, int]:
        t, p = (Counter(zip(*(x[i:] for i in range(n)))) for x in (_tokens(a, stems), _tokens(b, stems)))
        return (t & p).total(), max(t.total(), 1), max(p.total(), 1)

    return _scores(df, key, _counts(hits)(F.col(target), F.col(prediction)))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel: one big-integer step per item of b."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_places(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence, falling.

    Bit-parallel: column j of the table of lengths is kept as the set of places of a at which
    the length grows, one number per item of b. Walking back from the ends, equal items are
    taken; else where the length grows at the present place it does so without the item of b,
    which is left; else the item of a is left.
    """
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = v = (1 << len(a)) - 1
    grows = []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        grows.append(full ^ v)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        below = (2 << i) - 1
        # The next place to stop at: an equal item, or growth.
        i = ((where.get(b[j], 0) | grows[j]) & below).bit_length() - 1
        if i < 0:
            break
        if a[i] == b[j]:
            out.append(i)
            i -= 1
        j -= 1
    return out


def lsum_hits(targets: list[list], predictions: list[list]) -> int:
    """Items of the targets in the union of their subsequences with all predictions, each as often as the predictions hold it."""
    union = Counter(s[i] for s in targets for i in {i for other in predictions for i in lcs_places(s, other)})
    return (union & Counter(t for s in predictions for t in s)).total()


def rouge_l(df: DataFrame, key: str, target: str, prediction: str, stems: bool = False) -> DataFrame:
    """(``key``, ``precision``, ``recall``, ``fmeasure``) by the longest common subsequence."""

    def hits(a: str | None, b: str | None) -> tuple[int, int, int]:
        t, p = _tokens(a, stems), _tokens(b, stems)
        return lcs_length(t, p), len(t), len(p)

    return _scores(df, key, _counts(hits)(F.col(target), F.col(prediction)))


def rouge_lsum(df: DataFrame, key: str, target: str, prediction: str, stems: bool = False) -> DataFrame:
    """ROUGE-L over the lines of both texts."""

    def hits(a: str | None, b: str | None) -> tuple[int, int, int]:
        t, p = ([w for line in (x or "").split("\n") if (w := _tokens(line, stems))] for x in (a, b))
        return lsum_hits(t, p), sum(map(len, t)), sum(map(len, p))

    return _scores(df, key, _counts(hits)(F.col(target), F.col(prediction)))


def best_of(scores: DataFrame, key: str) -> DataFrame:
    """Of several targets per key, the scores of the one with the greatest F."""
    return scores.groupBy(key).agg(F.max(F.struct("fmeasure", "precision", "recall")).alias("_b")).select(key, "_b.precision", "_b.recall", "_b.fmeasure")


# Suffixes of the second and the third step and what replaces them, longest first.
SECOND = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"),
    ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("ator", "ate"), ("eli", "e"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))


def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in VOWELS and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = "".join("c" if consonant(w, i) else "v" for i in range(len(w)))
        return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds)))

    def vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def cvc(w: str) -> bool:
        n = len(w)
        return n > 2 and consonant(w, n - 1) and not consonant(w, n - 2) and consonant(w, n - 3) and w[-1] not in "wxy"

    def swap(w: str, rules: tuple[tuple[str, str], ...]) -> str:
        for old, new in rules:
            if w.endswith(old):
                base = w[: len(w) - len(old)]
                return base + new if measure(base) > 0 else w
        return w

    w = word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: len(w) - len(old)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(swap(w, SECOND), THIRD)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"):
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def meteor_score(
    reference: str, hypothesis: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, sense: Callable[[str], str] | None = None
) -> float:
    """METEOR with exact and stem matches, then by ``sense``: a function that gives words of one meaning the same name."""
    ref, hyp = (reference or "").lower().split(), (hypothesis or "").lower().split()
    free_r, free_h, pairs = list(enumerate(ref)), list(enumerate(hyp)), []
    for form in (str, stem, *([sense] if sense else [])):
        places: dict[str, list[int]] = {}
        for i, w in free_r:
            places.setdefault(form(w), []).append(i)
        for j, w in reversed(free_h):
            found = places.get(form(w))
            if found:
                pairs.append((j, found.pop()))
        taken_h, taken_r = {j for j, _ in pairs}, {i for _, i in pairs}
        free_h = [x for x in free_h if x[0] not in taken_h]
        free_r = [x for x in free_r if x[0] not in taken_r]
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(a[0] + 1 != b[0] or a[1] + 1 != b[1] for a, b in zip(pairs, pairs[1:]))
    m = len(pairs)
    p, r = m / len(hyp), m / len(ref)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / m) ** beta)


def meteor(df: DataFrame, key: str, target: str, prediction: str, sense: Callable[[str], str] | None = None) -> DataFrame:
    """(``key``, ``meteor``); see meteor_score."""

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([meteor_score(x, y, sense=sense) for x, y in zip(a, b)])

    return df.select(key, F.round(score(F.col(target), F.col(prediction)), 6).alias("meteor"))


def bootstrap(df: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(``low``, ``mid``, ``high``): 2.5, 50 and 97.5 per cent of the means of Poisson resamples.

    Each row weighs Poisson(1) in each resample, by a generator seeded with its key, so the
    result does not depend on partitions. Tasks send one sum per resample, never rows.
    """

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for part in parts:
            for k, v in zip(part["_k"], part["_v"]):
                w = np.random.Generator(np.random.Philox(key=[seed, int(k) & ((1 << 64) - 1)])).poisson(1.0, resamples)
                weight += w
                total += w * v
        yield pd.DataFrame({"b": range(resamples), "w": weight, "t": total})

    rows = df.select(F.xxhash64(key).alias("_k"), F.col(value).cast("double").alias("_v")).dropna()
    means = rows.mapInPandas(sums, "b int, w double, t double").groupBy("b").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return means.agg(*(F.round(F.percentile("m", p), 6).alias(n) for n, p in (("low", 0.025), ("mid", 0.5), ("high", 0.975))))


def eval_qa(gold: DataFrame, predictions: DataFrame, strict: bool = False) -> DataFrame:
    """One row (``rouge_l``, ``meteor``) over (``qid``, ``answer``); a missing prediction is the empty text.

    ``strict`` raises unless both have the same questions.
    """
    if strict and gold.select("qid").distinct().count() != predictions.select("qid").distinct().count():
        raise ValueError("gold and predictions differ in their questions")
    rows = gold.select("qid", F.col("answer").alias("_t")).join(predictions.select("qid", F.col("answer").alias("_p")), "qid", "left")
    rows = rows.withColumn("_p", F.coalesce("_p", F.lit("")))
    a = rouge_l(rows, "qid", "_t", "_p").select("qid", "fmeasure")
    return a.join(meteor(rows, "qid", "_t", "_p"), "qid").agg(F.round(F.avg("fmeasure"), 6).alias("rouge_l"), F.round(F.avg("meteor"), 6).alias("meteor"))
