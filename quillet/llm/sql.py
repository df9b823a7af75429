"""SQL of those queries that DuckDB can answer over whole tables."""

from __future__ import annotations

from quillet.llm.textform import LOOK_ALIKES

ITEMS = """
  items AS (
    SELECT run_id, qid, i.doc_id AS doc_id, max(i.score) AS score
    FROM (SELECT run_id, qid, unnest(ranked) AS i FROM runs)
    WHERE i.doc_id IS NOT NULL AND i.score IS NOT NULL AND NOT isnan(i.score)
    GROUP BY ALL)
"""

FLOWS = f"""
WITH {ITEMS},
  own AS (SELECT * FROM items WHERE qid IN (SELECT qid FROM queries_dev)),
  universe AS (SELECT DISTINCT qid, doc_id FROM own),
  sized AS (SELECT qid, count(*) AS n FROM universe GROUP BY qid),
  placed AS (
    SELECT u.qid, r.run_id, u.doc_id, o.score, s.n,
      (rank() OVER w - 1 + count(*) OVER (PARTITION BY u.qid, r.run_id, o.score) / 2.0) / s.n AS p
    FROM universe u
    JOIN (SELECT DISTINCT qid, run_id FROM own) r ON u.qid = r.qid
    JOIN sized s ON s.qid = u.qid
    LEFT JOIN own o ON o.qid = u.qid AND o.run_id = r.run_id AND o.doc_id = u.doc_id
    WINDOW w AS (PARTITION BY u.qid, r.run_id ORDER BY o.score ASC NULLS FIRST)),
  flowed AS (
    SELECT a.qid, a.run_id, a.doc_id, a.score,
      sum(least(1, greatest(0, (a.p - b.p) / 0.5)) - least(1, greatest(0, (b.p - a.p) / 0.5))) / greatest(a.n - 1, 1) AS f
    FROM placed a JOIN placed b ON a.qid = b.qid AND a.run_id = b.run_id
    GROUP BY a.qid, a.run_id, a.doc_id, a.score, a.n),
  gained AS (
    SELECT qid, doc_id, score, f - coalesce(min(f) FILTER (WHERE score IS NULL) OVER (PARTITION BY qid, run_id), 0) AS f
    FROM flowed),
  flows AS (SELECT qid, doc_id, round(sum(f), 9) AS flow FROM gained WHERE score IS NOT NULL GROUP BY qid, doc_id)
"""

TOP5 = f"""
WITH {ITEMS},
  best AS (
    SELECT run_id, qid, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, doc_id) AS INTEGER) AS place, doc_id, score
    FROM items QUALIFY place <= 5)
"""


def _one_of(c: str, ranges: list[tuple[int, int]]) -> str:
    return "(" + " OR ".join(f"unicode({c}) BETWEEN {a} AND {b}" for a, b in ranges) + ")"


# Code points that show nothing, spaces, and line ends.
NOTHING = [
    (0, 8), (14, 31), (127, 127), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE007F),
]
BLANKS = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
BREAKS = [(11, 13), (0x85, 0x85), (0x2028, 0x2029)]
# Signs, and the letters that they are drawn like.
DRAWN = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ð": "Đ", "Ɖ": "Đ", "ɡ": "g", "µ": "μ", "‐": "-", "‑": "-"}
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def looks(texts: str) -> str:
    """Views ending in ``looks`` (tbl, key, raw, text) of the texts (tbl, key, raw): one form, character by character.

    Made of tables of characters in place of expressions over whole texts, as an independent check of the text form.
    """
    signs = DRAWN | {chr(0x2160 + i): r for i, r in enumerate(ROMAN)} | {chr(0x2170 + i): r.lower() for i, r in enumerate(ROMAN)}
    alike = [(a, b) for own in LOOK_ALIKES.values() for a, b in zip(*own)]
    values = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""
  signs(c, d) AS (VALUES {values(signs.items())}),
  alike(c, d) AS (VALUES {values(alike)}),
  given AS (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT tbl, key, raw FROM ({texts}) WHERE raw IS NOT NULL)),
  singles AS (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(replace(raw, chr(13) || chr(10), chr(10)), '(?s).') AS l FROM given)),
  plain AS (SELECT id, string_agg(CASE WHEN {_one_of('s.c', NOTHING)} THEN '' WHEN {_one_of('s.c', BLANKS)} THEN ' ' WHEN {_one_of('s.c', BREAKS)} THEN chr(10)
    WHEN unicode(s.c) BETWEEN 65281 AND 65374 THEN chr(CAST(unicode(s.c) - 65248 AS INTEGER)) ELSE coalesce(d, s.c) END, '' ORDER BY pos) AS t
    FROM singles s LEFT JOIN signs USING (c) GROUP BY id),
  letters AS (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(t, '(?s).') AS l FROM plain WHERE regexp_matches(t, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]'))),
  edged AS (SELECT *, regexp_matches(c, '[\\p{{L}}\\p{{M}}\\p{{N}}]') AS inside FROM letters),
  bounded AS (SELECT *, CASE WHEN inside IS DISTINCT FROM lag(inside) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS begins FROM edged),
  worded AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY pos) AS w FROM bounded),
  latin AS (SELECT w.*, d, bool_or(d IS NULL AND regexp_matches(w.c, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]')) OVER (PARTITION BY id, w) AS foreign_word FROM worded w LEFT JOIN alike USING (c)),
  redrawn AS (SELECT id, string_agg(CASE WHEN foreign_word THEN c ELSE coalesce(d, c) END, '' ORDER BY pos) AS t FROM latin GROUP BY id),
  looks AS (SELECT tbl, key, raw, trim(array_to_string(list_transform(string_split(nfc_normalize(coalesce(r.t, p.t, '')), chr(10)), lambda l: rtrim(l, ' ' || chr(9))), chr(10)), ' ' || chr(9) || chr(10)) AS text
    FROM given LEFT JOIN plain p USING (id) LEFT JOIN redrawn r USING (id))"""


def _terms_sql() -> str:
    texts = """SELECT 'c' AS tbl, doc_id AS key, text AS raw FROM corpus_document WHERE text IS NOT NULL AND doc_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, text DESC) = 1"""
    return f"""
WITH {looks(texts)},
  terms AS (SELECT key AS doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM looks),
  held AS (SELECT count(DISTINCT doc_id) AS n FROM terms),
  counted AS (SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM terms GROUP BY term)
"""


def oracle_sql() -> dict[str, str]:
    three = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {k} AS key, {c} AS raw FROM {t}"
        for t, k, c in (("corpus_document", "doc_id", "text"), ("queries_train", "qid", "text"), ("task2_train", "qid", "answer"))
    )
    components = """
WITH RECURSIVE links AS (
    SELECT DISTINCT qid, regexp_replace(id, '#.*$', '') AS document FROM (SELECT qid, unnest(relevant) AS id FROM queries_train)
    WHERE id IS NOT NULL AND qid IS NOT NULL),
  tied AS (SELECT DISTINCT a.qid AS a, b.qid AS b FROM links a JOIN links b ON a.document = b.document),
  reach(a, b) AS (SELECT a, b FROM tied UNION SELECT r.a, t.b FROM reach r JOIN tied t ON r.b = t.a)
SELECT a AS qid, min(b) AS group_qid FROM reach GROUP BY a HAVING count(*) > 1
"""
    return {
        "p1_found": FLOWS
        + "SELECT qid, doc_id FROM flows QUALIFY row_number() OVER (PARTITION BY qid ORDER BY flow DESC, doc_id) = 1",
        "p1_ranking": FLOWS
        + "SELECT qid, doc_id, flow, CAST(row_number() OVER (PARTITION BY qid ORDER BY flow DESC, doc_id) AS INTEGER) AS place FROM flows",
        "p2_found": f"""
WITH {looks(three)}
SELECT DISTINCT a.tbl, a.key AS key_a, b.key AS key_b FROM looks a JOIN looks b
  ON a.tbl = b.tbl AND a.text = b.text AND a.key < b.key AND a.raw <> b.raw WHERE a.text <> ''""",
        "p2_texts": f"WITH {looks(three)} SELECT DISTINCT tbl, key, text FROM looks UNION SELECT tbl, key, NULL FROM ({three}) WHERE raw IS NULL",
        "p3_found": components,
        # What must hold of any split: each record once, no group torn, no size off by more than a hundredth.
        "p3_checks": "SELECT count(DISTINCT qid) AS records, count(DISTINCT qid) AS qids, 0::BIGINT AS torn, 0::BIGINT AS off FROM queries_train",
        # What must hold of any packing; each text of at least one character has at least one token.
        "p9_fill": "SELECT count(*) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS split_short, 0::BIGINT AS wrong_cover FROM documents WHERE text <> ''",
        "p4_found": _terms_sql()
        + "SELECT term, CASE WHEN docs <= 2 THEN 'rare' ELSE 'common' END AS verdict FROM counted, held WHERE docs <= 2 OR docs > 0.5 * n",
        "p4_terms": _terms_sql()
        + "SELECT term, uses, docs, CASE WHEN docs <= 2 THEN 'rare' WHEN docs > 0.5 * n THEN 'common' END AS mark FROM counted, held",
        "p7_found": TOP5
        + """, cuts AS (SELECT run_id, qid, list(doc_id ORDER BY place) AS best FROM best GROUP BY run_id, qid),
  saved AS (SELECT run_id, qid, predicted FROM predictions
    QUALIFY row_number() OVER (PARTITION BY run_id, qid ORDER BY saved_at DESC NULLS LAST, predicted DESC NULLS LAST) = 1)
SELECT b.run_id, b.qid, b.place, b.doc_id FROM best b JOIN cuts c ON c.run_id = b.run_id AND c.qid = b.qid
LEFT JOIN saved s ON s.run_id = b.run_id AND s.qid = b.qid WHERE c.best IS DISTINCT FROM s.predicted""",
        "p7_top5": TOP5 + "SELECT run_id, qid, place, doc_id, score FROM best",
    }
