"""Subject areas of documents by subject-specific interpolated n-gram language models.

A text is divided into its provisions (sentences or lines that end like one). Each subject
has a bigram model interpolated with its unigram model and with the background model; a
provision belongs to the subject whose per-token cross-entropy lies furthest below that of
the background. A document has each subject that holds at least a calibrated share of its
provisions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.textform import LOOK_ALIKES, PLAIN_SIGNS

#: Labelled documents that models are trained on, at most (chosen by the hash of the key).
MAX_LABELLED = 4000
#: Bytes of their texts, at most; a text that would exceed them is left out of the training.
MAX_BYTES = 64 << 20
#: Weights of the subject's bigram, the subject's unigram and the background model.
INTERPOLATION = (0.55, 0.25, 0.20)
#: Share of the greatest gain of a word, the logarithm of the number of subjects, that a provision needs to have one.
LEAST_SHARE = 0.3
#: One labelled document in so many calibrates the share of provisions.
HELD_OUT = 5
#: Weight of a provision's gain, and of its document's subjects, when it is divided among subjects.
SHARPNESS, DOCUMENT = 2.0, 0.5
#: Standard deviations that count as chance, and occurrences of the background added to a subject's.
NOISE, PULL = 1.5, 30.0

WORDS = re.compile(r"[^\W_]+").findall
ENDS = re.compile(r"(?<=[.!?;…])\s+(?=[^\W\da-z_])|\n+")
TAGS = re.compile(r"<[^<>]{0,200}>")
HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
STRANGE = re.compile("[Ͱ-֏！-～ÐƉ]")
BROKEN = re.compile("[Â-ô][\u0080-¿]")
TERMINAL = re.compile(r"[.!?;:…。]\W*$")
_DRAWN = str.maketrans(
    "".join(a for a, _ in LOOK_ALIKES.values()) + PLAIN_SIGNS[0] + "".join(map(chr, range(0xFF01, 0xFF5F))),
    "".join(b for _, b in LOOK_ALIKES.values()) + PLAIN_SIGNS[1] + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)),
)


def readable(text: str) -> str:
    """The text without markup, broken encoding, invisible and look-alike characters."""
    if len(BROKEN.findall(text)) > 3:
        # UTF-8 that was read as Latin-1; what is not broken stays as it is.
        text = re.sub(
            "[\u0080-ÿ]{2,}",
            lambda m: m[0].encode("latin-1").decode("utf-8", "ignore") or m[0],
            text,
        )
    if "<" in text:
        text = TAGS.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    text = HIDDEN.sub("", text)
    if STRANGE.search(text):
        text = text.translate(_DRAWN)
    return unicodedata.normalize("NFC", text)


def provisions(text: str) -> list[list[str]]:
    """The words of each provision; of each line where nothing ends like a sentence."""
    parts = [p for p in ENDS.split(readable(text)) if p]
    ended = [p for p in parts if TERMINAL.search(p) and len(p) > 12]
    return [w for w in (WORDS(p.lower()) for p in (ended or parts)) if w]


@dataclass
class Models:
    """Word ids, bigram keys and for each key the log gain of every subject over the background."""

    subjects: list[str]
    words: dict[str, int]
    keys: np.ndarray
    bigram_gain: np.ndarray
    unigram_gain: np.ndarray
    usual: float = 16.0
    share: float = 0.25

    def gains(self, texts: Iterable[str], whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Per provision the gains of all subjects; for each text its number of provisions.

        A gain is the background's cross-entropy per token less the subject's, in nats, times
        twice the usual number of tokens of a provision. A provision's tokens are taken with
        the usual number of background tokens, which gain nothing, so that neither the
        length of a long one nor the chance of a short one decides. With ``whole`` it is the
        difference of the provision's log-likelihoods, by which training weighs its evidence.
        """
        get, v = self.words.get, len(self.words)
        ids: list[int] = []
        ends: list[int] = []
        counts: list[int] = []
        for text in texts:
            own = provisions(text)
            counts.append(len(own))
            for words in own:
                ids.append(v)  # the begin of a provision
                ids.extend([get(w, v) for w in words])
                ends.append(len(ids))
        n = len(self.subjects)
        if not ids:
            return np.zeros((0, n), np.float32), np.array(counts, dtype=np.int64)
        token = np.array(ids, dtype=np.int64)
        pair = np.empty_like(token)
        pair[0], pair[1:] = 0, token[:-1] * (v + 1) + token[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), max(len(self.keys) - 1, 0))
        known = self.keys[at] == pair if len(self.keys) else np.zeros(len(pair), bool)
        starts = np.array([0, *ends[:-1]])
        out = np.empty((len(starts), n), np.float32)
        for k in range(n):
            column = np.where(known, self.bigram_gain[at, k], self.unigram_gain[token, k])
            column[starts] = 0
            out[:, k] = np.add.reduceat(column, starts)
        if not whole:
            # Per token, over the provision's own and as many of the background as are usual; few tokens tell little.
            out *= (2 * self.usual / (np.array(ends) - starts - 1 + self.usual))[:, None]
        return out, np.array(counts, dtype=np.int64)


def least_gain(n: int) -> float:
    """Nats by which a provision's likelihood must exceed the background's, with n subjects."""
    return LEAST_SHARE * float(np.log(max(n, 2)))


def _shrunk(counts: np.ndarray, totals: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shares of a subject, drawn towards the background's where chance can explain the difference."""
    expected = totals * share[:, None]
    excess = counts - expected
    excess = np.sign(excess) * np.maximum(np.abs(excess) - NOISE * np.sqrt(expected), 0)
    return (expected + excess + PULL * share[:, None]) / (totals + PULL)


def _estimate(subjects: list[str], weighted: list[tuple[list[str], np.ndarray]]) -> Models:
    """Models from provisions with a weight for each subject."""
    n = len(subjects)
    unigrams: dict[str, np.ndarray] = {}
    bigrams: dict[tuple[str, str], np.ndarray] = {}
    for words, weight in weighted:
        row = np.append(weight, 1.0)
        before = ""
        for w in words:
            for table, k in ((unigrams, w), (bigrams, (before, w))):
                if k in table:
                    table[k] += row
                else:
                    table[k] = row.copy()
            before = w
    words = {w: i for i, w in enumerate(unigrams)}
    v = len(words)
    uni = np.array(list(unigrams.values())).reshape(v, n + 1)
    p1 = (uni[:, n] + 0.01) / (uni[:, n].sum() + 0.01 * max(v, 1))
    kept = [k for k, row in bigrams.items() if row[n] >= 2]
    history = np.zeros((v + 1, n + 1))
    for (a, _), row in bigrams.items():
        history[words.get(a, v)] += row
    first = np.array([words.get(a, v) for a, _ in kept], dtype=np.int64)
    second = np.array([words[b] for _, b in kept], dtype=np.int64)
    two = np.array([bigrams[k] for k in kept]).reshape(len(kept), n + 1)
    l2, l1, l0 = INTERPOLATION
    two_share = two[:, n] / np.maximum(history[first, n], 1e-9)
    background = (l2 * two_share + l1 * p1[second]) / (l2 + l1)
    alone = _shrunk(uni[:, :n], uni[:, :n].sum(0, keepdims=True), p1)
    pairs = _shrunk(two[:, :n], history[first][:, :n], two_share)
    subject = l2 * pairs + l1 * alone[second] + l0 * background[:, None]
    gain = np.log(subject / background[:, None])
    alone = np.log(((l2 + l1) * alone + l0 * p1[:, None]) / p1[:, None])
    keys = first * (v + 1) + second
    order = np.argsort(keys)
    usual = sum(len(w) for w, _ in weighted) / max(len(weighted), 1)
    return Models(
        subjects, words, keys[order], gain[order].astype(np.float32),
        np.vstack([alone, np.zeros((1, n))]).astype(np.float32), usual,
    )


def train(labelled: list[tuple[str, list[str]]], steps: int = 3) -> Models:
    """Models from texts with their (partly wrong) subjects.

    First each provision counts for all subjects of its document alike. Then, step by step,
    a provision counts for the subjects that the last models give it, those named by the
    label being favoured; so that wrong labels and passing mentions lose weight.
    The share of provisions that a subject needs is the one that agrees best with the labels,
    among equal ones that nearest to the usual.
    """
    subjects = sorted({s for _, own in labelled for s in own})
    index = {s: i for i, s in enumerate(subjects)}
    prior = np.zeros((len(labelled), len(subjects)))
    for d, (_, own) in enumerate(labelled):
        for s in own:
            prior[d, index[s]] = 1 / len(own)
    # One document in HELD_OUT sets the share and trains nothing.
    held = np.arange(len(labelled)) % HELD_OUT == HELD_OUT - 1
    texts = [t for (t, _), h in zip(labelled, held) if not h]
    parts = [provisions(t) for t in texts]
    own = prior[~held]
    flat = [w for p in parts for w in p]
    models = _estimate(subjects, [(w, own[d]) for d, p in enumerate(parts) for w in p])
    for _ in range(steps if subjects else 0):
        gains, counts = models.gains(texts, whole=True)
        favour = np.log(np.repeat(own, counts, axis=0) * 0.9 + 0.1 / len(subjects))
        score = np.hstack([gains + favour, np.full((len(gains), 1), least_gain(len(subjects)) - 2.0)]).astype(np.float64)
        score = np.exp(score - score.max(1, keepdims=True))
        weight = (score / score.sum(1, keepdims=True))[:, :-1]
        models = _estimate(subjects, list(zip(flat, weight)))
    if held.any():
        gains, counts = models.gains([t for (t, _), h in zip(labelled, held) if h])
        truth = prior[held] > 0
        best = -1.0
        for share in sorted(np.arange(0.15, 0.36, 0.01), key=lambda x: abs(x - models.share)):
            made = accepted(gains, counts, float(share))
            f = 2 * (made & truth).sum() / max(made.sum() + truth.sum(), 1)
            if f > best + 1e-9:
                best, chosen = f, float(share)
        models.share = chosen
    return models


def accepted(gains: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """For each text which subjects hold at least ``share`` of its provisions with a subject.

    A provision is divided among the subjects and the background by its gains, once without
    and once with what the whole text is about. Each has half a provision at
    least; a text always has its greatest subject.
    """
    n = gains.shape[1]
    made = np.zeros((len(counts), n), bool)
    if not n:
        return made
    ends = np.cumsum(counts)
    held = np.zeros((len(counts), n))
    lean = SHARPNESS * gains.astype(np.float64)
    for step in (0, 1):
        if step:
            about = (held + 1e-9) / (held + 1e-9).sum(1, keepdims=True)
            lean = lean + DOCUMENT * np.log(np.repeat(about, counts, axis=0) + 0.02)
        logits = np.hstack([lean, np.full((len(lean), 1), SHARPNESS * least_gain(n) / 3)])
        weight = np.exp(logits - logits.max(1, keepdims=True, initial=-np.inf))
        weight /= weight.sum(1, keepdims=True)
        upto = np.vstack([np.zeros((1, n)), np.cumsum(weight[:, :n], axis=0)])
        held = upto[ends] - upto[ends - counts]
    made = (held >= share * held.sum(1, keepdims=True)) & (held >= 0.5)
    made[np.arange(len(counts)), held.argmax(1)] = True
    return made


def document_subjects(
    df: DataFrame, key: str, column: str, labels: DataFrame, subject: str = "subject", max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """Distinct rows (``key``, ``subject``): every subject that a text deals with.

    ``labels`` has hand labels (``key``, ``subject``); letter case is levelled, nulls and
    repeats are left out. At most ``max_labelled`` labelled documents, the first by the hash
    of their key, of MAX_BYTES together, train the models; all documents are classified,
    with their whole texts.
    A null or blank text gives no row, every other text at least one. Without any usable
    label the result is empty. Other columns are left out, so none can clash.
    """
    spark = df.sparkSession
    clean = (
        labels.select(F.col(key), F.lower(F.trim(F.col(subject))).alias("_s"))
        .filter("_s is not null and _s <> ''")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("_s")).alias("_subjects"))
        .orderBy(F.xxhash64(key), key)
        .limit(max_labelled)
    )
    texts = df.select(key, F.col(column).alias("_text")).filter("_text is not null and _text <> ''")
    # At most max_labelled rows; their sizes come first, then the texts that fit.
    sizes = texts.join(clean, key).select(key, F.octet_length("_text").alias("_n")).collect()
    fitting, room = [], MAX_BYTES
    for k, n in sorted(((r[0], r[1]) for r in sizes), key=lambda x: (xxhash.xxh3_64_intdigest(str(x[0])), x[1])):
        if n <= room:
            fitting.append((k, n))
            room -= n
    kept = spark.createDataFrame(fitting, f"`{key}` {df.schema[key].dataType.simpleString()}, _n int")
    sample = texts.withColumn("_n", F.octet_length("_text")).join(F.broadcast(kept.distinct()), [key, "_n"]).join(clean, key).select("_text", "_subjects", key).collect()
    sample.sort(key=lambda r: str(r[2]))
    models = train([(r[0], list(r[1])) for r in sample if r[0].strip()])
    shared = spark.sparkContext.broadcast(models)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if not m.subjects:
            return
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                some = [(i, t) for i, t in enumerate(part.column(1).to_pylist()) if HIDDEN.sub("", t).strip()]
                made = accepted(*m.gains([t for _, t in some]), m.share)
                rows, which = np.nonzero(made)
                at = pa.array([some[r][0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array([m.subjects[k] for k in which], pa.string())], names=[key, "subject"]
                )

    kind = df.schema[key].dataType.simpleString()
    return texts.mapInArrow(classify, f"`{key}` {kind}, subject string").distinct()
