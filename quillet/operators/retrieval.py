"""Lexical and dense retrieval: index tables, scores and top k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import terms, tokenize
from quillet.session import cut
from quillet.sources.rankings import ranked


def postings(corpus: DataFrame, key: str = "doc_id", text: str = "text", stopwords: bool = False) -> DataFrame:
    """(``doc_id``, ``dl``, ``term``, ``tf``); a document without terms has one row with a null term."""
    tokens = corpus.select(F.col(key).alias("doc_id"), tokenize(F.col(text), stopwords=stopwords).alias("tokens"))
    return (
        tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))
        .groupBy("doc_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def term_stats(index: DataFrame, n: int) -> DataFrame:
    """(``term``, ``df``, ``idf``) over an index of n documents."""
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf)


def token_index(corpus: DataFrame, key: str = "doc_id", text: str = "text", stopwords: bool = False) -> DataFrame:
    """(``doc_id``, ``tokens``): the index by document, one row each."""
    return corpus.select(F.col(key).alias("doc_id"), tokenize(F.col(text), stopwords=stopwords).alias("tokens"))


#: Documents of one row of a packed index, and postings that one task holds.
PACK, HELD = 512, 24_000_000


def _narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def pack(index: DataFrame) -> DataFrame:
    """An index of (``doc_id``, ``tokens``), or texts (``doc_id``, ``text``), as rows of up to ``PACK`` documents.

    (``docs``, ``lengths``, ``sizes``, ``terms``, ``df``, ``term``, ``tf``): terms and postings of each document
    (``lengths``, ``sizes``), the row's terms with their number of documents, and its postings by document
    and then term as numbers. Numbers are kept as bytes, headed by their type.
    """
    kind = index.schema["doc_id"].dataType.simpleString()
    source = "tokens" if "tokens" in index.columns else "text"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACK):
                batch = whole.slice(start, PACK)
                lists = batch.column(source)
                if source == "text":
                    lists = pa.array(map(terms, lists.to_pylist()), pa.list_(pa.string()), size=len(lists))
                coded = lists.flatten().dictionary_encode()
                n = max(len(coded.dictionary), 1)
                keys, tf = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
                doc, term = keys // n, keys % n
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                made = [length, np.bincount(doc, minlength=batch.num_rows), term, tf]
                lengths, sizes, term, tf = ([x.dtype.char.encode() + x.tobytes()] for x in map(_narrow, made))
                df = np.bincount(keys % n, minlength=len(coded.dictionary)).astype(np.int32)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(batch.column("doc_id")), pa.array(lengths, pa.binary()), pa.array(sizes, pa.binary()),
                        one(coded.dictionary.cast(pa.string())), one(pa.array(df)), pa.array(term, pa.binary()), pa.array(tf, pa.binary()),
                        pa.array([batch.num_rows], pa.int64()), pa.array([int(length.sum())], pa.int64()), pa.array([len(keys)], pa.int64()),
                    ],
                    names=["docs", "lengths", "sizes", "terms", "df", "term", "tf", "n", "n_terms", "n_postings"],
                )

    made = f"docs array<{kind}>, lengths binary, sizes binary, terms array<string>, df array<int>, term binary, tf binary, n long, n_terms long, n_postings long"
    return index.select("doc_id", source).mapInArrow(rows, made)


def query_terms(queries: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    return (
        queries.select(F.col(key).alias("qid"), F.explode(tokenize(F.col(text))).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count("*").alias("qtf"))
    )


def query_weights(packed: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(``qid``, ``terms``, ``weights``): of each query its terms in the corpus, in their order, with idf · qtf."""
    df = packed.select(F.explode(F.arrays_zip("terms", "df")).alias("_t")).groupBy(F.col("_t.terms").alias("term")).agg(F.sum("_t.df").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    items = F.array_sort(F.collect_list(F.struct("term", (idf * F.col("qtf")).alias("w"))))
    made = query_terms(queries).join(df, "term").groupBy("qid").agg(items.alias("_i"))
    return made.select("qid", F.transform("_i", lambda x: x["term"]).alias("terms"), F.transform("_i", lambda x: x["w"]).alias("weights"))


#: Cells (query, document) that a task scores at once.
CELLS = 4_000_000


class _Best:
    """The best k documents of each query (by number) seen so far in a task."""

    def __init__(self, k: int):
        self.k, self.kept, self.rows = k, [], 0

    def add(self, scores: np.ndarray, names: np.ndarray, positive: bool) -> None:
        """Rows of ``scores`` are queries, columns the documents ``names``; all that tie with the last place stay until they are ordered."""
        mask = scores > 0 if positive else np.ones(scores.shape, bool)
        if scores.shape[1] > self.k:
            mask &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
        q, d = np.nonzero(mask)
        self._cut(q, names[d], scores[q, d])

    def _cut(self, q: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        self.kept.append((q, names, scores))
        self.rows += len(q)
        if len(self.kept) > 1 and self.rows > 2 * CELLS // 8:
            self.kept = [self.best()]
            self.rows = len(self.kept[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, names, scores = (np.concatenate(x) for x in zip(*self.kept))
        _, order = np.unique(names, return_inverse=True)
        at = np.lexsort((order, -scores, q))
        q, names, scores = q[at], names[at], scores[at]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(begins, np.diff(begins, append=len(q)))
        kept = place < self.k
        return q[kept], names[kept], scores[kept]


class _Asked:
    """Queries with their weights, as arrays that are broadcast: query i has the terms ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, table: pa.Table):
        qids, terms, weights = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.combine_chunks().select(["qid", "terms", "weights"]).columns)
        self.qids, self.weight = qids, weights.flatten().to_numpy()
        self.at = np.append(0, pc.list_value_length(terms).to_numpy()).astype(np.int64).cumsum()
        coded = terms.flatten().dictionary_encode()
        self.terms, self.term = coded.dictionary, coded.indices.to_numpy()

    def __len__(self) -> int:
        return len(self.at) - 1


class _Held:
    """The documents of a task with their postings of asked terms, by document: document i has those from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, batches: Iterator[pa.RecordBatch], terms: pa.Array):
        self.share = 0
        names, length, size, term, tf = [], [], [], [], []
        numbers = lambda x: np.frombuffer(x, x[:1].decode(), offset=1)
        for batch in batches:
            for i in range(batch.num_rows):
                self.share = batch.column("share")[i].as_py()
                own = batch.column("terms")[i].values
                number = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int32)
                sizes = numbers(batch.column("sizes")[i].as_py()).astype(np.int64)
                found = number[numbers(batch.column("term")[i].as_py())]
                kept = found >= 0
                names.append(batch.column("docs")[i].values)
                length.append(numbers(batch.column("lengths")[i].as_py()).astype(np.float64))
                size.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes)))
                term.append(found[kept])
                tf.append(numbers(batch.column("tf")[i].as_py())[kept])
        self.names = pa.chunked_array(names).combine_chunks() if names else pa.array([], pa.string())
        self.length = np.concatenate([np.zeros(0), *length])
        self.at = np.concatenate([[0], *size]).astype(np.int64).cumsum()
        self.term, self.tf = np.concatenate([np.zeros(0, np.int32), *term]), np.concatenate([np.zeros(0, np.uint8), *tf])
        _, self.order = np.unique(np.array(self.names.to_pylist(), dtype=object), return_inverse=True)

    def __len__(self) -> int:
        return len(self.length)


#: Share of the cells (query, document) of a block, below which a term is added alone; terms that are multiplied as a matrix; the least score.
ALONE, WIDE, LEAST = 0.003, 4096, np.float32(1e-45)


class _Pool:
    """Of each query all documents that may be among its best k by approximate scores, whose share of error is ``error``."""

    def __init__(self, n: int, k: int, error: np.ndarray, digits: int | None):
        self.k, self.error, self.off = k, error, 0.0 if digits is None else 1.01 * 10.0**-digits
        self.q, self.d, self.score = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
        self.new, self.rows, self.last = [], 0, 0
        self.floor = np.full(n, LEAST, np.float32)

    def _raise(self, q: np.ndarray, kth: np.ndarray) -> None:
        low = kth.astype(np.float64) * (1 - 2 * self.error[q]) - self.off
        self.floor[q] = np.maximum(self.floor[q], np.nextafter(low.astype(np.float32), np.float32(-np.inf)))

    def add(self, scores: np.ndarray, begin: int) -> None:
        """Rows of ``scores`` are documents from ``begin``, columns the queries."""
        if not self.rows and len(scores) > self.k:
            self._raise(np.arange(scores.shape[1]), np.partition(np.ascontiguousarray(scores.T), -self.k, axis=1)[:, -self.k])
        at = _found(scores >= self.floor)
        d, q = np.divmod(at, scores.shape[1])
        self.new.append((q.astype(np.int32), (d + begin).astype(np.int32), scores.ravel()[at]))
        self.rows += len(at)
        if self.rows > 1.5 * self.last:
            self.shrink()

    def shrink(self) -> None:
        q, d, score = (np.concatenate(x) for x in zip((self.q, self.d, self.score), *self.new))
        # Positive numbers are in the order of their bits: one number sorts by query and descending score.
        bits = np.iinfo(np.int32).max - score.view(np.int32).astype(np.int64)
        keys = np.sort((q.astype(np.int64) << 32) | bits)
        begins = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
        full = begins[np.diff(begins, append=len(keys)) >= self.k]
        kth = np.iinfo(np.int32).max - (keys[full + self.k - 1] & 0xFFFFFFFF)
        self._raise(keys[full] >> 32, kth.astype(np.int32).view(np.float32))
        kept = score >= self.floor[q]
        self.q, self.d, self.score, self.new = q[kept], d[kept], score[kept], []
        self.rows = len(self.q)
        self.last = max(self.rows, 1)


def _found(mask: np.ndarray) -> np.ndarray:
    """Where a mask that is almost empty is set, as places in its flat form; looked through by eights."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    eight, one = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[eight] * 8 + one, np.flatnonzero(flat[whole:]) + whole])


class _Block:
    """Queries ``begin`` to ``end`` against the documents of a task.

    All scores are made approximately in single precision: terms that are frequent in both as
    a product of matrices, others by adding. Those that may be among the best k by the bound
    of the error are made again exactly, summed in the order of the query's terms.
    """

    def __init__(self, asked: _Asked, begin: int, end: int, held: _Held):
        self.n, self.held, self.begin = end - begin, held, begin
        lo, hi = asked.at[begin], asked.at[end]
        self.at, self.weight = asked.at[begin : end + 1] - lo, asked.weight[lo:hi]
        self.terms, self.term = np.unique(asked.term[lo:hi], return_inverse=True)
        self.local = np.full(len(asked.terms), -1, np.int32)
        self.local[self.terms] = np.arange(len(self.terms))
        query = np.repeat(np.arange(self.n), np.diff(self.at))
        order = np.argsort(self.term, kind="stable")
        self.of_query, self.of_weight = query[order], self.weight[order].astype(np.float32)
        self.of = np.searchsorted(self.term[order], np.arange(len(self.terms) + 1))
        df = np.zeros(len(self.terms) + 1, np.int64)
        for i in range(0, len(held.term), CELLS):
            df += np.bincount(self.local[held.term[i : i + CELLS]] + 1, minlength=len(df))
        heavy = np.diff(self.of) * df[1:]
        wide = np.argsort(-heavy, kind="stable")[:WIDE]
        wide = wide[heavy[wide] > ALONE * self.n * len(held)]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), self.n), np.float32)
        own = self.column[self.term]
        self.matrix[own[own >= 0], query[own >= 0]] = self.weight[own >= 0]

    def postings(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents (from 0), terms and their number of the documents ``begin`` to ``end``."""
        lo, hi = self.held.at[begin], self.held.at[end]
        term = self.local[self.held.term[lo:hi]]
        kept = term >= 0
        return np.repeat(np.arange(end - begin), np.diff(self.held.at[begin : end + 1]))[kept], term[kept], self.held.tf[lo:hi][kept]

    def pools(self, impact: list[Callable], k: int, digits: int | None) -> list[_Pool]:
        # Each score has as many products as the query has terms: each rounds, and so do both its factors and each sum.
        error = (np.diff(self.at) + 8) * 2.0**-24
        pools = [_Pool(self.n, k, error, digits) for _ in impact]
        first, step = (max(min(x // self.n, 2048), 1) for x in (CELLS, CELLS // 4))
        many = np.diff(self.of)
        begin = 0
        while begin < len(self.held):
            # The first documents are more, for floors to begin with; later ones few, so that their scores stay in a cache.
            end = min(begin + (step if begin else first), len(self.held))
            doc, term, tf = self.postings(begin, end)
            length = self.held.length[begin + doc]
            column = self.column[term]
            wide = np.flatnonzero(column >= 0)
            at = doc[wide] * self.matrix.shape[0] + column[wide]
            alone = np.flatnonzero(column < 0)
            each = many[term[alone]]
            places = np.arange(each.sum()) + np.repeat(self.of[term[alone]] - (each.cumsum() - each), each)
            cell = np.repeat(doc[alone] * self.n, each) + self.of_query[places]
            weight = self.of_weight[places]
            for pool, f in zip(pools, impact):
                made = f(tf, length).astype(np.float32)
                matrix = np.zeros((end - begin, self.matrix.shape[0]), np.float32)
                matrix.ravel()[at] = made[wide]
                scores = matrix @ self.matrix
                np.add.at(scores.ravel(), cell, np.repeat(made[alone], each) * weight)
                pool.add(scores, begin)
            begin = end
        return pools

    def exact(self, pool: _Pool, impact: Callable, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of each query: (query, document, score), in order."""
        pool.shrink()
        order = np.argsort(pool.d, kind="stable")
        q, d = pool.q[order], pool.d[order]
        scores = np.zeros(len(q))
        many = np.diff(self.at)
        step = max(min(CELLS // 8 // (len(self.terms) + 1), 2048), 1)
        matrix = np.zeros((min(step, len(self.held)), len(self.terms)))
        for begin in range(0, len(self.held), step):
            end = min(begin + step, len(self.held))
            lo, hi = np.searchsorted(d, [begin, end])
            if lo == hi:
                continue
            doc, term, tf = self.postings(begin, end)
            matrix[doc, term] = impact(tf, self.held.length[begin + doc])
            while lo < hi:
                n = many[q[lo:hi]].cumsum()
                at = lo + max(int(np.searchsorted(n, CELLS // 4, side="right")), 1)
                own, size = q[lo:at], many[q[lo:at]]
                starts = size.cumsum() - size
                pair = np.repeat(np.arange(at - lo), size)
                item = np.arange(len(pair)) - starts[pair] + self.at[own][pair]
                scores[lo:at] = np.add.reduceat(self.weight[item] * matrix[(d[lo:at] - begin)[pair], self.term[item]], starts)
                lo = at
            matrix[doc, term] = 0
        if digits is not None:
            scores = np.round(scores, digits)
        order = np.lexsort((self.held.order[d], -scores, q))
        order = order[scores[order] > 0]
        q, d, scores = q[order], d[order], scores[order]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        kept = np.arange(len(q)) - np.repeat(begins, np.diff(begins, append=len(q))) < k
        return q[kept], d[kept], scores[kept]


#: Lists of one block, in documents.
LISTED = 2_000_000


def _ranker(shared, settings: list[tuple[float, float]], avgdl: float, top_k: int, digits: int | None, block: int, shares: int):
    impact = [lambda n, length, k1=k1, b=b: n * (k1 + 1) / (n + k1 * (1 - b + b * length / avgdl)) for k1, b in settings]
    block = min(block, max(LISTED // (len(settings) * top_k), 64))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        held = _Held(batches, asked.terms)
        first, last = (len(asked) * x // shares for x in (held.share, held.share + 1))
        for begin in range(first, last if len(held) else first, block):
            own = _Block(asked, begin, min(begin + block, last), held)
            pools = own.pools(impact, top_k, digits)
            for number, f in enumerate(impact):
                q, d, scores = own.exact(pools[number], f, top_k, digits)
                pools[number] = None
                begins = np.flatnonzero(np.diff(q, prepend=-1))
                at = pa.array(np.append(begins, len(q)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((q[begins] + np.int64(begin)) * len(settings) + number), pa.ListArray.from_arrays(at, held.names.take(pa.array(d))), pa.ListArray.from_arrays(at, pa.array(scores))],
                    names=["key", "docs", "scores"],
                )

    return rank


def _merger(shared, settings: list[tuple[float, float]], top_k: int):
    """Lists of the same key, which follow each other, as rows: those with a score of the best k."""
    each = np.array(settings)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, lists = batch.column("docs"), batch.column("scores")
        key = batch.column("key").to_numpy()[pc.list_parent_indices(lists).to_numpy()]
        scores = lists.flatten().to_numpy()
        order = np.lexsort((-scores, key))
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        size = np.diff(begins, append=len(key))
        last = scores[order[begins + np.minimum(size, top_k) - 1]]
        order = order[scores[order] >= np.repeat(last, size)]
        q, number = np.divmod(key[order], len(settings))
        return pa.RecordBatch.from_arrays(
            [pa.array(each[number, 0]), pa.array(each[number, 1]), shared.value.qids.take(pa.array(q)), docs.flatten().take(pa.array(order)), pa.array(scores[order])],
            names=["k1", "b", "qid", "doc_id", "score"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield rows(batch.slice(0, end))
            rest = batch.slice(end)
        if rest is not None:
            yield rows(rest)

    return merge


#: Blocks of queries that are broadcast at once; bytes of a posting and of a document in a list, about.
BLOCKS, POSTING, LISTING = 32, 2, 16


def _tiles(tasks: int, postings: int, lists: int, queries: int) -> tuple[int, int]:
    """In how many shares the documents and the queries are divided among the tasks: those that move the fewest bytes.

    Each share of the queries takes a copy of the index, each share of the documents a copy of the lists.
    """
    least = max(-(-postings // HELD), 1)

    def shares(docs: int) -> int:
        return min(-(-tasks // docs), max(queries // 64, 1))

    docs = min(range(least, max(tasks, least) + 1), key=lambda x: (shares(x) * postings * POSTING + (x > 1) * x * lists * LISTING, x))
    return docs, shares(docs)


def bm25_search(
    index: DataFrame, queries: DataFrame, settings: list[tuple[float, float]] = ((1.2, 0.75),), top_k: int = 100, block: int = 4096, digits: int | None = None
) -> DataFrame:
    """(``k1``, ``b``, ``qid``, ``doc_id``, ``score``, ``rank``): the top k of each query with a positive score, per setting.

    The index, or the texts (``doc_id``, ``text``), lies by document, so a document's whole score is made in one task. It is read
    once and kept as packed postings. A task holds a share of the documents and multiplies it
    with a share of the queries, in blocks of at most ``block``, and makes one list of k
    documents per query; where the documents have several shares, the lists are merged.
    The queries are broadcast in at most ``BLOCKS`` blocks, as numbers. One pass over the index
    serves a whole grid of settings. ``digits`` rounds scores before they are compared, for
    those who want near scores to tie.
    """
    spark = index.sparkSession
    settings = [(float(k1), float(b)) for k1, b in settings]
    packed = cut(pack(index))
    size = packed.agg(F.count("*"), F.sum("n"), F.sum("n_terms"), F.sum("n_postings")).first()
    n = int(size[1] or 0)
    avgdl = float((size[2] or 0) / max(n, 1)) or 1.0
    asked = cut(query_weights(packed, queries, n))
    count = asked.count()
    parts = max(-(-count // (BLOCKS * block)), 1)
    docs, shares = _tiles(2 * spark.sparkContext.defaultParallelism, int(size[3] or 0), count * top_k * len(settings), count // parts)
    held = packed.select("docs", "lengths", "sizes", "terms", "term", "tf", F.pmod(F.monotonically_increasing_id(), F.lit(docs)).alias("_d"))
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionById(docs * shares, (F.col("_d") * shares + F.col("share")).cast("int")).drop("_d")
    kind = index.schema["doc_id"].dataType.simpleString()
    flat = f"k1 double, b double, qid {queries.schema['qid'].dataType.simpleString()}, doc_id {kind}, score double"

    def search(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(_Asked(part.toArrow()))
        rank, merge = _ranker(shared, settings, avgdl, top_k, digits, block, shares), _merger(shared, settings, top_k)
        if docs == 1:
            return held.mapInArrow(lambda batches: merge(rank(batches)), flat)
        lists = held.mapInArrow(rank, f"key long, docs array<{kind}>, scores array<double>")
        return lists.repartition("key").sortWithinPartitions("key").mapInArrow(merge, flat)

    made = [search(asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) if parts > 1 else asked) for i in range(parts)]
    return ranked(reduce(DataFrame.unionByName, made), ["k1", "b", "qid"], top_k)


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top_k: int = 100, digits: int | None = None) -> DataFrame:
    """(``qid``, ``doc_id``, ``score``, ``rank``) of one setting."""
    return bm25_search(corpus.select("doc_id", "text"), queries, [(k1, b)], top_k, digits=digits).drop("k1", "b")


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64, unit: bool = True) -> DataFrame:
    """(``key``, ``vector``) by an encoder function over batches of texts, of length one with ``unit``; a null text counts as empty.

    The function is shipped to the tasks; it may load its model on its first call there.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["_text"].tolist()
            for i in range(0, len(texts), batch):
                made = np.asarray(encoder(texts[i : i + batch]), dtype=np.float64)
                if unit:
                    made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: part[key].iloc[i : i + batch].to_numpy(), "vector": list(made)})

    return df.select(key, F.coalesce(text, F.lit("")).alias("_text")).mapInPandas(run, f"`{key}` {kind}, vector array<double>")


def dense_search(docs: DataFrame, queries: DataFrame, key: str, vector: str, top_k: int = 10, block: int = 4096, digits: int | None = None) -> DataFrame:
    """Exact top k by inner product: (``qid``, ``doc_id``, ``score``, ``rank``).

    The queries go in blocks of at most ``block`` vectors, each broadcast once; every task
    multiplies its documents with a block and sends on its top k of all its documents, so
    that only these rows are shuffled. Non-positive scores stay. Null vectors do not exist.
    ``digits`` rounds scores before they are compared.
    """
    spark = docs.sparkSession
    some = docs.select(F.col(key).alias("doc_id"), F.col(vector).alias("v")).dropna()
    asked = queries.select(F.col(key).alias("qid"), F.col(vector).alias("v")).dropna()
    kind = docs.schema[key].dataType.simpleString()
    rows, made = [], []

    def search(rows: list) -> DataFrame:
        ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            best = _Best(top_k)
            step = max(CELLS // len(names), 1)
            for whole in parts:
                for start in range(0, len(whole), step):
                    part = whole.iloc[start : start + step]
                    scores = q @ np.vstack(part["v"].to_numpy()).astype(np.float64).T
                    best.add(scores if digits is None else np.round(scores, digits), part["doc_id"].to_numpy(), False)
            if best.kept:
                at, found, scores = best.best()
                yield pd.DataFrame({"qid": [names[i] for i in at], "doc_id": found, "score": scores})

        return some.mapInPandas(run, f"qid {kind}, doc_id {kind}, score double")

    for r in asked.toLocalIterator():  # one partition of queries at a time, a block each
        rows.append(r)
        if len(rows) == block:
            made.append(search(rows))
            rows = []
    if rows:
        made.append(search(rows))
    if not made:
        made.append(some.select(F.col("doc_id").alias("qid"), "doc_id", F.lit(0.0).alias("score")).limit(0))
    return ranked(reduce(DataFrame.unionByName, made), ["qid"], top_k)
