"""Encoding of texts with a public byte-level BPE vocabulary.

Each distinct piece of text is merged once per Python worker with a segment tree over the
ranks of adjacent pairs; its ids are kept as raw int32 bytes, so that the ids of a whole
Arrow batch are joined, never boxed.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_RANK = 1 << 60
#: Distinct pieces whose ids a worker keeps (about 100 bytes each); beyond it the store starts anew.
KEPT_PIECES = 400_000
#: Longer pieces are encoded and not kept.
KEPT_BYTES = 256


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    """The pattern that divides a text into pieces, as the public tokenizers state it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the leftmost of the lowest-ranked adjacent pairs is merged.

    A segment tree holds for each position the rank of the pair that begins there; its
    root is the minimum of (rank, position). A merge changes the pairs of two positions
    and kills one, each a logarithmic update; it ends when no pair has a rank.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    # A key is rank * size + position: its order is that of (rank, leftmost position).
    none = NO_RANK * size
    tree = [none] * (2 * size)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while tree[1] < none:
        i = tree[1] % size
        j = end[i]
        k = end[j]
        end[i] = k
        put(j, none)
        if k < n:
            before[k] = i
            r = ranks.get(piece[i : end[k]])
            put(i, none if r is None else r * size + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:k])
            put(h, none if r is None else r * size + h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Pieces to ids, with a store of pieces already seen."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {
                base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())
            }
        self.pieces = regex.compile(pattern).findall
        self.store = _Store(self.ranks)

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 in the machine's byte order."""
        store = self.store
        if len(store) > KEPT_PIECES:
            store.clear()
        return b"".join([store[p] for p in self.pieces(text)])


class _Store(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        from array import array

        # A lone surrogate cannot come from a Spark string; it would become U+FFFD.
        made = array("i", merge_piece(piece.encode("utf-8", "replace"), self.ranks)).tobytes()
        if len(piece) <= KEPT_BYTES:
            self[piece] = made
        return made


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker; built once and reused by later tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _lists(parts: list[bytes]) -> pa.Array:
    import numpy as np

    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
    )


def _rows(
    key: str, column: str, name: str, made: Callable[[list[bytes]], pa.Array], path: str, pattern: str
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for batch in batches:
            # Short slices bound the memory of a batch by the longest texts in it.
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = part.column(column).to_pylist()
                ids = [encode(t) if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(key), made(ids)], names=[key, name])

    return run


def encode_texts(
    df: DataFrame, key: str, column: str, path: str | None = None, out: str = "ids"
) -> DataFrame:
    """One row (``key``, ``out``) per row of df: the token ids of ``column`` as array<int>.

    Special tokens are not known: their spellings within a text are ordinary text. Null and
    empty texts give an empty list; blank texts are encoded like any other. Repeated rows
    stay, a null key is kept, other columns are left out (so none can clash). There is no
    limit on the length of a text. The vocabulary file must lie at ``path`` on all workers.
    """
    if out == key:
        raise ValueError("the ids need another name than the key")
    kept = [f for f in df.schema.fields if f.name == key]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])
    run = _rows(key, column, out, _lists, path or vocabulary_path(), piece_pattern())
    return df.select(F.col(key), F.col(column)).mapInArrow(run, schema)


def token_counts(
    df: DataFrame, key: str, column: str, path: str | None = None, out: str = "tokens"
) -> DataFrame:
    """As encode_texts, with the number of tokens in place of the ids."""
    if out == key:
        raise ValueError("the count needs another name than the key")
    kept = [f for f in df.schema.fields if f.name == key]
    schema = T.StructType([*kept, T.StructField(out, T.IntegerType())])

    def sizes(ids: list[bytes]) -> pa.Array:
        return pa.array([len(x) // 4 for x in ids], pa.int32())

    run = _rows(key, column, out, sizes, path or vocabulary_path(), piece_pattern())
    return df.select(F.col(key), F.col(column)).mapInArrow(run, schema)
