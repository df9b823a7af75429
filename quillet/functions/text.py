"""Normalisation, tokenisation and small text functions, as functions on columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _letters() -> str:
    """Latin letters and the Vietnamese ones: vowels with each tone mark, and đ."""
    toned = [unicodedata.normalize("NFC", v + t) for v in "aăâeêioôơuưy" for t in ("", "̀", "́", "̃", "̉", "̣")]
    lower = "".join(sorted({*"abcdefghijklmnopqrstuvwxyz", *toned, "đ"}))
    return lower + lower.upper()


LETTERS = _letters()


def _ranges(letters: str) -> str:
    """The same class of characters by its ranges, which Java matches several times faster than single ones."""
    codes = sorted(map(ord, set(letters)))
    begins = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(begins, ends))


#: Open syllables whose tone mark has two customary places.
TONE_PAIRS = (
    "oà òa", "oá óa", "oả ỏa", "oã õa", "oạ ọa", "oè òe", "oé óe", "oẻ ỏe", "oẽ õe", "oẹ ọe",
    "uỳ ùy", "uý úy", "uỷ ủy", "uỹ ũy", "uỵ ụy",
)
TONES = {
    form(a): form(b)
    for a, b in (pair.split() for pair in TONE_PAIRS)
    for form in (str, str.capitalize, str.upper)
}
#: Function words that may be left out of the terms.
STOPWORDS = tuple(
    "và của có là được cho trong với các những này đó khi thì mà để từ đến về tại bởi hoặc nếu như một sẽ đã cũng vào ra nên".split()
)
ZERO_WIDTH = "[​-‏﻿­]"
_TONE = re.compile("[" + "".join({p[0] for p in TONES}) + "][" + "".join({p[1] for p in TONES}) + "](?![" + LETTERS + "])")
_ZERO = re.compile(ZERO_WIDTH)


def composed(t: str | None) -> str | None:
    if t is None:
        return None
    t = _ZERO.sub("", unicodedata.normalize("NFC", t)).replace("\u00a0", " ")
    return _TONE.sub(lambda m: TONES.get(m[0], m[0]), t)


@pandas_udf(T.StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Precomposed form without zero-width characters, NBSP as space, tone marks in one place."""

    return texts.map(composed, na_action="ignore")


@pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no function."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: White space as in (?U)\\s.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space, Unicode's included, at the ends, which alone are looked at."""
    return F.trim(text, F.lit(WHITE))


def blank_to_space(text: Column) -> Column:
    """Each run of white space, Unicode's included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, lower: bool = True, keep_newlines: bool = False) -> Column:
    """Composition, tone places, lower case, white space; null gives the empty string. Idempotent."""
    t = compose(F.coalesce(text, F.lit("")))
    if lower:
        t = F.lower(t)
    if not keep_newlines:
        return blank_to_space(t)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?m)(?U)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def tokens_of(normal: Column, min_len: int = 1, stopwords: bool = False, token_class: str = "vi") -> Column:
    """Terms of a normalised text; identifiers such as 100/2019/nđ-cp stay whole.

    ``token_class``: ``vi`` has the Vietnamese letters only, ``unicode`` every letter.
    """
    letters = _ranges(LETTERS) if token_class == "vi" else r"\p{L}"
    found = F.regexp_extract_all(normal, F.lit(f"[{letters}0-9_/.\\-]+"), F.lit(0))
    bare = F.transform(found, lambda w: F.trim(w, F.lit("./-")))
    kept = F.filter(bare, lambda w: (w != "") & (F.length(w) >= min_len))
    if stopwords:
        kept = F.filter(kept, lambda w: ~w.isin(*STOPWORDS))
    return kept


def tokenize(text: Column, min_len: int = 1, stopwords: bool = False, token_class: str = "vi") -> Column:
    # White space is in no term, so that it need not be made one space.
    return tokens_of(F.lower(compose(F.coalesce(text, F.lit("")))), min_len, stopwords, token_class)


_TERM = re.compile("[" + _ranges(LETTERS) + "0-9_/.\\-]+")


def terms(text: str | None) -> list[str]:
    """The terms of ``tokenize`` within Python, where a text is there anyway."""
    return [w for w in (x.strip("./-") for x in _TERM.findall(composed(text or "").lower())) if w]


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def fingerprint(text: Column) -> Column:
    """SHA-1 of the text regardless of letter case and white space; null for blank texts."""
    flat = F.lower(blank_to_space(text))
    return F.when(flat != "", F.sha1(flat.cast("binary")))


def encoder_text(text: Column, prefix: str = "") -> Column:
    """Text for an encoder without segmentation, with the model's prefix."""
    return F.concat(F.lit(prefix), normalize(text, lower=False))


def expand(text: Column, abbreviations: dict[str, str]) -> Column:
    """Each abbreviation replaced by its long form, in the given order."""
    for short, full in abbreviations.items():
        text = F.replace(text, F.lit(short), F.lit(full))
    return text


def postprocess_answer(text: Column) -> Column:
    """An answer without a leading label, up to the first blank line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?U)^(Trả lời:|Answer:)\s*", "")
    return F.regexp_replace(F.split(t, "\n\n", 2)[0], r"(?U)^\s+|\s+$", "")


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" …"))).otherwise(text)


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; every other letter divides, by definition of the metric."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


# The same in DuckDB's SQL, for the oracle queries.

_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def blank_sql(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_SPACE}+', ' ', 'g'))"


def compose_sql(t: str) -> str:
    t = f"replace(regexp_replace(nfc_normalize(coalesce({t}, '')), '[\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}\\x{{AD}}]', '', 'g'), chr(160), ' ')"
    for a, b in TONES.items():
        t = f"regexp_replace({t}, '{a}([^{LETTERS}]|$)', '{b}\\1', 'g')"
    return t


def normalize_sql(t: str, lower: bool = True) -> str:
    made = compose_sql(t)
    return blank_sql(f"lower({made})" if lower else made)


def tokens_sql(normal: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({normal}, '[{LETTERS}0-9_/.\\-]+'), "
        "lambda w: trim(w, './-')), lambda w: w <> '')"
    )


def words_sql(t: str) -> str:
    return f"list_filter(string_split_regex(coalesce({t}, ''), '{_SPACE}+'), lambda w: w <> '')"


def rouge_tokens_sql(t: str) -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')"
