import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.llm import bpe, defects, packing, subjects, textform

NFD = lambda s: unicodedata.normalize("NFD", s)


def looks(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r.canonical for r in textform.canonical_text(df, "t").orderBy("id").collect()]


def test_same_looks(spark):
    same = ["Hồ sơ 12, Theo", NFD("Hồ sơ 12, Theo"), "Ｈồ sơ １２， Τhеο", "Hồ​ sơ­ 12,　Theo  "]
    assert set(looks(spark, *same)) == {"Hồ sơ 12, Theo"}
    assert looks(spark, "Ðiều Ɖ", "a\r\nb \n", "ﬁ Ⅳ") == ["Điều Đ", "a\nb", "fi IV"]
    # Signs that stand for letters beside letters of other scripts, and within words with look-alikes.
    assert looks(spark, "ﬁle Ж", "file Ж", "Ⅳ khoản α", "IV khoản α", "ﬁΤ", "ⅣА") == ["file Ж", "file Ж", "IV khoản α", "IV khoản α", "fiT", "IVA"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aÂâđ\u0302\u0323 \t\n\r\u00a0\u200b\u00adＡ１ﬁⅣοΤЖаµÅ가\u1112.x"), max_size=12), min_size=1, max_size=30))
def test_untouched_texts_are_in_the_form_already(texts):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("b", pa.table({"i": list(range(len(texts))), "t": texts}))
    want = [r[0] for r in con.sql(f"SELECT {textform.canonical_sql('t')} FROM b ORDER BY i").fetchall()]
    made = textform.canonical_batches("t", "t")(iter([pa.record_batch([pa.array(texts)], names=["t"])]))
    assert [x for b in made for x in b.column("t").to_pylist()] == want


def test_different_looks(spark):
    texts = ["ma", "má", "Ma", "m2", "m²", "закон", "hoà", "hòa", "a b", "ab", "αβγ", "한국 法律", "a  b"]
    made = looks(spark, *texts)
    assert made == texts and len(set(made)) == len(texts)


def test_empty_texts_and_clashing_columns(spark):
    assert looks(spark, None, "", " ​　 ", "x" * 200_000) == [None, "", "", "x" * 200_000]
    df = spark.createDataFrame([("ａ", "old", "more")], "t string, canonical string, look string")
    row = textform.canonical_text(df, "t").first()
    assert row.canonical == "a" and row.look == "more" and row.t == "ａ"
    assert textform.canonical_text(df.limit(0), "t").count() == 0


def test_look_alike_pairs(spark):
    rows = [("1", "Luật"), ("2", NFD("Luật")), ("3", "Luật"), ("4", "luật"), ("5", None), ("6", "​"), ("7", " "), ("2", NFD("Luật")), (None, "Luật")]
    df = spark.createDataFrame(rows, "key string, look string")
    assert {tuple(r) for r in textform.look_alike_pairs(df, "key", "look").collect()} == {("1", "2"), ("2", "3")}
    assert textform.look_alike_pairs(df.limit(0), "key", "look").count() == 0
    classes = textform.look_alike_classes(df, "key", "look").collect()
    assert sorted(r.key for r in classes) == ["1", "2", "3"] and len({r.look for r in classes}) == 1 and len({r.spelling for r in classes}) == 2


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(library, text):
    own = bpe.encoder(bpe.vocabulary_path(), bpe.piece_pattern()).encode(text)
    assert np.frombuffer(own, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_a_table(spark, library):
    texts = [None, "", " ", "<|endoftext|> Điều 1", "a" * 3000, "1" * 5000, "\n\n  x", "한국 🇻🇳 " * 50, "a" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(df, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_merges_take_the_leftmost_lowest_pair():
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"aa": 1, b"ab": 0, b"aaa": 2, b"abab": 3}
    for n in range(1, 7):
        for word in {bytes(random.Random(i).choice(b"ab") for _ in range(n)) for i in range(60)}:
            parts = [word[i : i + 1] for i in range(n)]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found or len(parts) == 1:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            whole = ranks.get(word)
            assert bpe.merge_piece(word, ranks) == ([whole] if whole is not None else [ranks[p] for p in parts])


def check_plan(sizes, capacity):
    """The number of containers, after a check that each item lies in one and none overflows."""
    containers, runs = packing.plan_containers(sizes, capacity)
    load = [0] * containers
    for s, n in sizes.items():
        own = [r for r in runs.tolist() if r[0] == s]
        for (_, first, per, container), end in zip(own, [*(r[1] for r in own[1:]), n]):
            for i in range(first, end):
                load[container + (i - first) // per] += s
        assert own[0][1] == 0
    assert max(load, default=0) <= capacity and min(load, default=1) > 0
    assert sum(load) == sum(s * n for s, n in sizes.items())
    return containers


def best_fit_decreasing(sizes, capacity):
    """The plain way, one item after the other."""
    from bisect import bisect_left, insort

    rooms, containers = [], 0
    for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        at = bisect_left(rooms, s)
        if at == len(rooms):
            containers += 1
            room = capacity
        else:
            room = rooms.pop(at)
        insort(rooms, room - s)
    return containers


DISTRIBUTIONS = {
    "uniform": (5000, lambda r: r.randint(1, 4096)), "fewer": (1000, lambda r: r.randint(1, 4096)), "short": (20000, lambda r: r.randint(1, 64)),
    "lognormal": (20000, lambda r: min(4096, max(1, int(r.lognormvariate(6, 1))))), "thirds": (5000, lambda r: r.randint(600, 2100)), "few": (100, lambda r: r.randint(1, 4096)),
}


@pytest.mark.parametrize("name", DISTRIBUTIONS)
def test_plans_never_need_more_than_best_fit(name):
    n, draw = DISTRIBUTIONS[name]
    rng, sizes = random.Random(5), {}
    for _ in range(n):
        s = draw(rng)
        sizes[s] = sizes.get(s, 0) + 1
    made = check_plan(sizes, 4096)
    least = -(-sum(s * k for s, k in sizes.items()) // 4096)
    assert made <= best_fit_decreasing(sizes, 4096) and least / made > 0.92
    if name == "thirds":  # where best fit wastes room that the program finds
        assert made < 0.985 * best_fit_decreasing(sizes, 4096)


def test_the_program_has_a_part_at_every_size(monkeypatch):
    calls = []
    real = packing.fractional_configurations
    monkeypatch.setattr(packing, "fractional_configurations", lambda *a: calls.append(1) or real(*a))
    for n in (1, 100, 390, 5000):
        check_plan({3000 + i % 500: 1 + n // 500 for i in range(min(n, 500))}, 4096)
    assert len(calls) == 4


def test_plans():
    assert packing.plan_containers({}, 100)[0] == 0
    assert check_plan({3000: 5000}, 4096) == 5000 and check_plan({4096: 7}, 4096) == 7 and check_plan({1: 1}, 1) == 1
    check_plan({2048: 5001, 1: 3}, 4096)
    check_plan({1365: 9000, 683: 100, 4096: 10}, 4096)
    with pytest.raises(ValueError):
        packing.plan_containers({5000: 1}, 4096)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 97), st.integers(1, 40), max_size=30))
def test_any_plan(sizes):
    assert check_plan(sizes, 97) <= best_fit_decreasing(sizes, 97)


def test_configurations_are_worth_most():
    rng = random.Random(3)
    for _ in range(30):
        weights = np.array(sorted(rng.sample(range(1, 40), 6)))
        values = np.array([rng.random() * w for w in weights])
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1], *(best[c - w] + v for w, v in zip(weights, values) if w <= c)])
        config = packing._price(weights, values, 60)
        assert (config * weights).sum() <= 60 and float((config * values).sum()) == pytest.approx(best[60])


def test_packing_a_table(spark):
    rng = random.Random(2)
    texts = [None, "", "luật " * 3000] + ["luật " * rng.randint(1, 300) for _ in range(200)] + ["a b"] * 30
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, container string")
    rows = packing.pack_texts(df, "doc_id", "text", capacity=512).collect()
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(df, "doc_id", "text").collect()}
    load, ranges = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.end_token - r.first_token
        ranges.setdefault(r.doc_id, []).append((r.first_token, r.end_token))
    assert max(load.values()) <= 512 and set(load) == set(range(len(load)))
    for k, n in counts.items():
        own = sorted(ranges.get(k, []))
        assert [b for _, b in own[:-1]] == [a for a, _ in own[1:]] and (not n or (own[0][0], own[-1][1]) == (0, n))
        assert n > 512 or len(own) == (n > 0)
    assert sum(load.values()) / (512 * len(load)) > 0.93
    assert packing.pack_texts(df.limit(0), "doc_id", "text").count() == 0


QUESTION = "Khi hộ gia đình ở xã Hạ Điền nộp chậm giấy tờ, mức xử phạt đối với tái định cư là bao lâu?"
SOUND = "Theo Điều 5 Nghị định 12/2020/QĐ-LV, hộ gia đình phải gia hạn hồ sơ trong thời hạn 30 ngày."


@pytest.mark.parametrize(
    "answer, expected",
    [
        (None, "empty"), ("", "empty"), (" ​", "empty"), ("...", "empty"), ("N/A", "empty"), ("Trả lời:", "empty"), ("<p></p>", "empty"), ("(trống)", "empty"),
        (QUESTION, "copy"), (QUESTION.upper().replace(",", ""), "copy"), ("Về câu hỏi: " + QUESTION, "copy"),
        ("Rất tiếc, hệ thống không thể trả lời câu hỏi này. Vui lòng liên hệ luật sư.", "refusal"),
        ("The holder shall register the file within 13 days and keep records of the fee.", "other_language"),
        ("Le demandeur doit déclarer les frais au bureau dans un délai de 10 jours.", "other_language"),
        (SOUND + " Trong trường hợp", "truncated"), (SOUND + "\n2.", "truncated"), (SOUND[:-20] + "…", "truncated"), (SOUND + " Hồ sơ gồm có:", "truncated"),
        (SOUND + " Việc rà soát tại xã [...]", "truncated"),
        (SOUND, None), (SOUND + "\nTrân trọng", None), (SOUND + "\nNguồn: Quy chế 1/2020/QĐ-LV", None), (SOUND + "\n(Ban biên tập)", None),
        (SOUND + " Bạn còn vướng mắc nào khác không?", None), (SOUND[:-1] + "./.", None), ("Có. " + SOUND, None), ("Với thắc mắc: " + QUESTION + " " + SOUND * 3, None),
    ],
)
def test_defects(answer, expected):
    defect, marked, _ = defects.Judge()(QUESTION, answer)
    # A model without any context completes no answer that lacks its mark.
    assert (defect or (None if marked else "truncated")) == expected


def test_short_questions_are_copied_too():
    judge = defects.Judge()
    for question in ("Thuế?", "Án phí", "Án là gì?", "a", "Phí?"):
        assert judge(question, question)[0] == "copy" and judge(question, question.upper() + "!!")[0] == "copy"
    assert judge("Án là gì?", "Án là phán quyết của tòa.")[0] is None
    assert judge("Thuế?", SOUND)[0] is None


@pytest.mark.parametrize(
    "answer",
    [
        "Cảm ơn bạn đã hỏi. Tôi không thể trả lời câu hỏi này.", "Xin chào. Cảm ơn bạn. Rất tiếc. Hệ thống từ chối giải đáp.", QUESTION + " Chúng tôi không bình luận.",
        "Thank you for asking. I cannot answer this question.", "Chúng tôi đã nhận được câu hỏi. Vấn đề này vượt quá phạm vi tư vấn. Theo Điều 5, bạn hỏi nơi khác.",
    ],
)
def test_refusals_after_sentences_that_say_nothing(answer):
    assert defects.Judge()(QUESTION, answer)[0] == "refusal"


def test_refusals_within_an_answer_are_none():
    assert defects.Judge()(QUESTION, SOUND + " Hồ sơ không đủ thông tin thì bị trả lại.")[0] is None


def test_whole_ends_are_read():
    long = SOUND + " " + "Việc này do ủy ban thực hiện. " * 40
    assert defects.ending(long + "Trong trường hợp" + "\n" * 400 + "…" + "!" * 500)[0] == "cut"
    assert defects.ending(long + "\n2." + " " * 5000)[0] == "cut"
    assert defects.ending(long + "\nNguồn:" + " " * 900 + "Quy chế 1/2020/QĐ-" + "L" * 700)[0] == "marked"
    assert defects.ending("")[0] == "bare"


def test_defects_of_a_table(spark):
    rows = [("1", QUESTION, None, "x"), ("1", QUESTION, None, "x"), ("2", None, SOUND, "x"), ("3", QUESTION, QUESTION, "x"), ("4", QUESTION, "a" * 50_000, "x"), (None, QUESTION, "", "x")]
    df = spark.createDataFrame(rows, "qid string, text string, answer string, defect string")
    got = {tuple(r) for r in defects.defective_pairs(df, "qid", "text", "answer").collect()}
    assert got == {("1", "empty"), ("3", "copy"), ("4", "truncated"), (None, "empty")}
    assert defects.defective_pairs(df.limit(0), "qid", "text", "answer").count() == 0


def test_the_terminal_model(spark):
    inside = "Theo Điều 5, hộ gia đình phải nộp giấy chứng minh cho ủy ban và giữ giấy chứng minh tại nhà."
    rows = [(f"s{i}", inside.replace("5", str(i))) for i in range(300)]
    # Closed by a full stop within a phrase that goes on everywhere else; three exact copies do not vouch for each other.
    rows += [(f"broken{i}", "Theo Điều 7, cá nhân phải nộp giấy chứng.") for i in range(3)]
    rows += [("bare", "Theo Điều 7, cá nhân phải nộp sổ tại nhà"), ("open", "Theo Điều 7, cá nhân phải nộp sổ rồi"), ("new", "Theo Điều 7, cá nhân phải nộp cổ vật.")]
    # Seen forty times within sentences, which is too few to say that none ends there.
    rows += [(f"few{i}", f"Căn cứ Nghị định {i}, cá nhân phải nộp sổ tại nhà.") for i in range(40)] + [("sound", "Hộ gia đình phải nộp sổ. Xem thêm Nghị định.")]
    df = spark.createDataFrame([(k, QUESTION, a) for k, a in rows], "qid string, text string, answer string")
    got = {tuple(r) for r in defects.defective_pairs(df, "qid", "text", "answer").collect()}
    assert got == {*((f"broken{i}", "truncated") for i in range(3)), ("open", "truncated")}


def topical(rng, subject):
    names = {"tax": ["thuế suất", "hóa đơn", "tờ khai"], "sport": ["trọng tài", "huấn luyện viên", "giải đấu"], "land": ["thửa đất", "địa chính", "tái định cư"]}
    who, tail = rng.choice(["Hộ gia đình", "Chi nhánh", "Cá nhân"]), rng.choice(["theo mẫu kèm theo", "nếu hồ sơ hợp lệ"])
    return f"{who} phải đăng ký {rng.choice(names[subject])} {tail}."


def test_subjects(spark):
    rng = random.Random(1)
    docs, truth = [], {}
    for i in range(400):
        own = rng.sample(["tax", "sport", "land"], rng.choice([1, 1, 2]))
        lines = [topical(rng, s) for s in own for _ in range(4)]
        rng.shuffle(lines)
        docs.append((i, "Nghị định số 5\n" + "\n".join(lines), "x"))
        truth[i] = set(own)
    docs += [(1000, None, "x"), (1001, " ​", "x"), (1002, "xyz", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(i, s.upper() if i % 5 else s) for i in range(150) for s in truth[i]] + [(3, None), (None, "tax"), (3, " ")], "doc_id long, subject string")
    got = {}
    for r in subjects.document_subjects(df, "doc_id", "text", labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got[i] == truth[i] for i in range(150, 400)) > 240
    assert 1000 not in got and 1001 not in got and len(got[1002]) == 1
    assert subjects.document_subjects(df, "doc_id", "text", labels.limit(0)).count() == 0
    assert subjects.document_subjects(df.limit(0), "doc_id", "text", labels).count() == 0


def test_readable():
    broken = "Điều khoản về đất".encode().decode("latin-1")
    assert subjects.readable(broken) == "Điều khoản về đất"
    assert subjects.readable("<p>a &amp; b</p>").strip() == "a & b"
