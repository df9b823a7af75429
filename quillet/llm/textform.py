"""One consistent form for texts that look the same.

The work is embedded SQL: each Arrow partition goes through an in-process DuckDB, whose
``nfc_normalize``, ``translate`` and regular expressions map compatibility forms,
invisible characters, spaces and look-alike letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.session import cut

# Characters that show nothing.
INVISIBLE = (
    "[\\x{00}-\\x{08}\\x{0E}-\\x{1F}\\x{7F}\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}"
    "\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}"
    "\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E007F}]"
)
# Spaces that look like the ordinary one, and line ends.
SPACES = "[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
LINE_ENDS = "\\r\\n|[\\r\\x{0B}\\x{0C}\\x{85}\\x{2028}\\x{2029}]"
# Letters of other scripts, and the Latin letters they look like.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԚԜаеоѕіјрсухһԁԛԝӏҮЁёЇїӐӑӒӓӖӗѐ", "ABESIJKMHOPCTYXYQWaeosijpcyxhdqwlYËëÏïĂăÄäĔĕè"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),
    "Armenian": ("ՕՏօսհ", "OSouh"),
}
# Signs that look the same in any word.
PLAIN_SIGNS = ("ÐƉɡµ‐‑", "ĐĐgμ--")

#: Rows that DuckDB takes at once.
SLICE = 2048

#: Ligatures and Roman numerals; and what else the steps change: full-width signs and line ends.
SPELLED = "\\x{FB00}-\\x{FB06}\\x{2160}-\\x{217B}"
MORE = "\\x{FF01}-\\x{FF5E}\\r\\x{0B}\\x{0C}\\x{85}\\x{2028}\\x{2029}"
FOREIGN = "[\\p{Cyrillic}\\p{Greek}\\p{Armenian}]"


def _wide() -> tuple[str, str]:
    """Full-width forms and the ordinary characters, by their fixed distance."""
    codes = range(0xFF01, 0xFF5F)
    return "".join(map(chr, codes)), "".join(chr(c - 0xFEE0) for c in codes)


def _spelled() -> list[tuple[str, str]]:
    """Ligatures and Roman numerals that are drawn like the letters they stand for."""
    codes = [*range(0xFB00, 0xFB07), *range(0x2160, 0x216C), *range(0x2170, 0x217C)]
    return [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in codes]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The DuckDB expression that brings the expression ``text`` to one form.

    Signs that stand for letters are spelled out first, so that these letters count for the
    word that the sign stands in; then words that are drawn in Latin letters get them.
    """
    source, target = (a + b for a, b in zip(_wide(), PLAIN_SIGNS))
    t = f"regexp_replace({text}, {_quoted(INVISIBLE)}, '', 'g')"
    t = f"regexp_replace({t}, {_quoted(LINE_ENDS)}, chr(10), 'g')"
    t = f"regexp_replace({t}, {_quoted(SPACES)}, ' ', 'g')"
    t = f"translate({t}, {_quoted(source)}, {_quoted(target)})"
    spelled = "t0"
    for sign, letters_of in _spelled():
        spelled = f"replace({spelled}, {_quoted(sign)}, {_quoted(letters_of)})"
    t = f"(SELECT CASE WHEN regexp_matches(t0, {_quoted(f'[{SPELLED}]')}) THEN {spelled} ELSE t0 END FROM (SELECT {t} AS t0))"
    letters, latin = ("".join(x) for x in zip(*LOOK_ALIKES.values()))
    word = f"translate(w, {_quoted(letters)}, {_quoted(latin)})"
    # A word is drawn in Latin letters if each of its letters is Latin or looks so.
    mixed = (
        "array_to_string(list_transform(regexp_extract_all(t1, '[\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}]+'), "
        f"lambda w: CASE WHEN NOT regexp_matches(w, {_quoted(FOREIGN)}) OR regexp_matches({word}, {_quoted(FOREIGN)}) THEN w ELSE {word} END), '')"
    )
    return (
        f"(SELECT regexp_replace(regexp_replace(nfc_normalize(CASE WHEN regexp_matches(t1, {_quoted(FOREIGN)}) THEN {mixed} ELSE t1 END), "
        f"'[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') FROM (SELECT {t} AS t1))"
    )


def _touched_sql(text: str) -> str:
    """Whether any step of canonical_sql but composition could change a text."""
    inside = "".join(x[1:-1] for x in (INVISIBLE, SPACES, FOREIGN))
    signs = "".join(f"\\x{{{ord(c):X}}}" for c in PLAIN_SIGNS[0])
    return f"regexp_matches({text}, {_quoted(f'[{inside}{signs}{SPELLED}{MORE}]|^[[:space:]]|[[:space:]]$|[ \\t]\\n')})"


def canonical_batches(column: str, out: str):
    """A function for mapInArrow that adds ``out``, the consistent form of ``column``.

    Texts that are composed and hold nothing for a step of the SQL to change are in the form
    already; DuckDB finds and maps the others.
    """
    touched = f"SELECT {_touched_sql('t')} AS c FROM batch ORDER BY i"
    sql = f"SELECT {canonical_sql('t')} AS c FROM batch ORDER BY i"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "preserve_insertion_order": True})

        def made(query: str, texts: pa.Array) -> pa.Array:
            con.register("batch", pa.table({"t": texts, "i": pa.array(range(len(texts)), pa.int64())}))
            out = con.sql(query).to_arrow_table().column("c").combine_chunks()
            con.unregister("batch")
            return out

        for whole in batches:
            # Short slices bound the memory of a call by the longest texts in it.
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = batch.column(column).cast(pa.string())
                loose = pa.array([t is not None and not unicodedata.is_normalized("NFC", t) for t in texts.to_pylist()], pa.bool_())
                mask = pc.or_(pc.fill_null(made(touched, texts), False), loose)
                if pc.any(mask).as_py():
                    texts = pc.replace_with_mask(texts, mask, made(sql, texts.filter(mask)).cast(pa.string()))
                names, columns = list(batch.schema.names), list(batch.columns)
                if out in names:
                    columns[names.index(out)] = texts
                else:
                    names.append(out)
                    columns.append(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def canonical_text(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """df with ``out``: the text of ``column`` in one form, so that looking alike is equality.

    Full-width forms, spaces, line ends, combining accents, look-alike letters, ligatures
    and invisible characters come out in one way; letter case, accents and superscripts
    stay. Blanks at line ends and at the ends of the text show nothing and go. A word
    with a letter that looks like no Latin one keeps its script.

    Null text gives null, a text without visible characters the empty string. A column
    that is already named ``out`` is replaced. Whole texts are processed; no limit on
    length. Rows are neither added nor dropped.
    """
    fields = [f for f in df.schema.fields if f.name != out or f.name == column]
    replaced = out in df.columns
    schema = T.StructType(
        [T.StructField(out, T.StringType()) if f.name == out else f for f in df.schema.fields]
        if replaced
        else [*fields, T.StructField(out, T.StringType())]
    )
    return df.mapInArrow(canonical_batches(column, out), schema)


def look_alike_classes(df: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct rows (``key``, ``look``, ``spelling``) of the texts that look like another text without being equal to it.

    Equal ``look`` means looking the same, equal ``spelling`` being the same; both are
    digests, so no text is shuffled. One row per record and spelling, however large a class
    is. Null keys, null texts and texts without visible characters have no row; repeated
    rows count once; an empty table gives no rows.
    """
    records = (
        canonical_text(df.select(F.col(key).alias("key"), F.col(column).alias("text")).dropna(), "text", "look")
        .filter("look <> ''")
        .select("key", F.sha2("look", 256).alias("look"), F.sha2("text", 256).alias("spelling"))
    )
    records = cut(records.distinct())
    # Least and greatest spelling differ where there are two; both are combined before the shuffle.
    several = records.groupBy("look").agg((F.min("spelling") < F.max("spelling")).alias("_several")).filter("_several").select("look")
    return records.join(several, "look", "left_semi").select("key", "look", "spelling")


def look_alike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Pairs ``key_a < key_b`` whose texts look the same and are not equal, made from look_alike_classes.

    Spellings are paired first (one row per pair of spellings), then replaced by the keys
    that have them, so that a group of exact copies, however large, is never paired with
    itself. Nulls, repeats and empty tables are as in look_alike_classes.
    """
    records = cut(look_alike_classes(df, key, column))
    spellings = records.select("look", "spelling").distinct()
    pairs = (
        spellings.withColumnRenamed("spelling", "one")
        .join(spellings.withColumnRenamed("spelling", "other"), "look")
        .filter("one < other")
        .select("one", "other")
    )
    return (
        pairs.join(records.select(F.col("spelling").alias("one"), F.col("key").alias("k1")), "one")
        .join(records.select(F.col("spelling").alias("other"), F.col("key").alias("k2")), "other")
        .filter("k1 <> k2")
        .select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))
        .distinct()
    )
