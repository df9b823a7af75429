"""Defective question and answer pairs, each with its kind of defect.

Copies show by compression: an answer that a zstandard dictionary made of its question
shrinks to almost nothing says only the question again. Languages and refusals are known
by dictionaries, broken-off answers by marks of omission and by a model of the contexts in
which sentences end, counted over all answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.textform import canonical_batches
from quillet.session import cut

#: A copy keeps at most this share of its compressed size when the question is the dictionary.
COPY_SHARE = 0.34
#: Level of compression; the shares hardly differ between levels.
LEVEL = 5
#: Contexts that end a sentence more rarely in other answers break an answer off; they must be
#: seen so often there that at least one end would be expected, 1 / LEAST_END times.
LEAST_END = 0.002
#: Contexts that end one at least so often complete an answer that only lacks its mark, if seen so often.
SURE_END, SURE_SEEN = 0.9, 30
#: Distinct contexts that a task counts before it sends them on.
FLUSH = 200_000

# Words that head an answer without saying anything.
PREFIX = re.compile(r"^\W*(?:(?:câu\s+)?trả lời|đáp án|đáp|answer|réponse|response|a)\s*[:：\-]\s*", re.I)
# What stands in place of an answer.
PLACEHOLDERS = {
    "", "n a", "na", "null", "none", "nil", "nan", "trống", "rỗng", "empty", "tbd", "todo", "undefined",
    "không có", "chưa có", "chưa cập nhật", "đang cập nhật", "không có câu trả lời", "chưa có câu trả lời",
    "no answer", "unknown", "vide", "blank", "để trống", "bỏ trống", "không có nội dung", "chưa trả lời",
}
# Phrases by which an answer is declined.
REFUSALS = (
    "không thể trả lời", "không thể giải đáp", "không thể cung cấp", "không thể kết luận", "không thể hỗ trợ",
    "không thể tư vấn", "chưa thể trả lời", "chưa thể cung cấp", "chưa thể giải đáp", "chưa thể tư vấn",
    "chưa thể hỗ trợ", "miễn trả lời", "từ chối trả lời", "từ chối giải đáp", "từ chối tư vấn",
    "không có khả năng hỗ trợ", "không có khả năng trả lời", "không có đủ thông tin", "không đủ thông tin",
    "không đủ dữ kiện", "không có đủ dữ kiện", "không tìm thấy căn cứ", "không tìm thấy thông tin",
    "không bình luận", "không được phép đưa ra ý kiến", "không được phép tư vấn", "không đưa ra lời khuyên",
    "không đưa ra ý kiến", "không chứa nội dung cần thiết", "không được đưa ra ở đây", "vượt quá phạm vi",
    "nằm ngoài phạm vi", "ngoài khả năng", "không hỗ trợ yêu cầu", "không thể đáp ứng", "xin không trả lời",
    "i cannot answer", "i can't answer", "cannot provide", "can't provide", "unable to answer",
    "unable to provide", "not able to answer", "i am an ai", "as an ai", "cannot help with", "can't help with",
    "je ne peux pas répondre", "je ne suis pas en mesure", "impossible de répondre", "ne pouvons pas répondre",
)
# Phrases of sentences that open an answer without being one.
COURTESIES = (
    "cảm ơn", "cám ơn", "xin chào", "chào bạn", "chào anh", "chào chị", "kính chào", "kính gửi", "thân gửi", "xin lỗi", "rất tiếc", "thành thật",
    "câu hỏi của bạn", "thắc mắc của bạn", "vấn đề bạn hỏi", "đã nhận được", "đã tiếp nhận", "thank you", "thanks for", "hello", "dear ", "sorry",
    "your question", "merci", "bonjour", "désolé", "votre question",
)
# Common words of languages; letters that only Vietnamese has count for it as well.
LANGUAGES = {
    "vi": "và của các có được trong theo cho không người này với là một những khi đã phải từ bản số điều tại do nếu thì về gồm hoặc hồ sơ",
    "en": "the of and to in is shall that for it with as be on not by or this must may are at which any from within before under after should where upon each an",
    "fr": "le la les de des et du un une est en que pour dans par sur au aux ne pas ou doit peut sont avec selon après ce cette chaque dans délai d l s",
    "de": "der die das und ist nicht ein eine zu den mit auf für von dem des im werden muss kann oder bei nach",
    "es": "el los las del y que es una por con para no se su al o debe puede este esta según",
}
VIETNAMESE = re.compile("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
# Closing formulas and notes that may follow a complete answer, from their first word on.
CLOSING = re.compile(
    r"(?:(?:thân ái|thân mến|trân trọng(?: kính chào| cảm ơn)?|kính chào|kính thư|cảm ơn bạn|xin cảm ơn|"
    r"chúc bạn[^.!?\n]{0,40}|\(?(?:ban biên tập|bbt)\)?|best regards|regards|cordialement)\s*+[.!]*(?:/\.)?"
    r"|\(?(?:nguồn|căn cứ|theo|xem|trích|tham khảo)\s*+:\s*+[^\n;]{0,120}?\d+/\d{4}/[\w\-Đđ]+\s*+\)?\.?"
    r"|\([^()\n]{0,60}\d+/\d{4}/[\w\-Đđ]+\s*+\)\.?)\s*+$",
    re.I,
)
CLOSING_BEGINS = re.compile(r"\(|\b(?:thân|trân|kính|cảm|xin|chúc|ban|bbt|best|regards|cordialement|nguồn|căn|theo|xem|trích|tham)\b", re.I)
CUT_MARK = re.compile(
    r"(?:…|\.\.\.|\[\s*+\.*\s*+\]|[\[(][^\[\]()]{0,25}(?:cắt|tiếp|lược|còn nữa|continued|suite)[^\[\]()]{0,25}[\])])\W*+$", re.I
)
DANGLING = re.compile(r"(?:(?:^|\n|[.;:!?]\s)\s*+(?:\d{1,3}|[a-zđ])\s*+[.)]|[,;:(\[\-–—/])$", re.I)
SENTENCE_END = re.compile(r"[.!?。]['\"»”)\]]*$")
MARKUP = re.compile(r"<[^<>]{0,200}>")
WORDS = re.compile(r"[^\W_]+").findall
SPOKEN = re.compile(r"([^\W_]+)([\W_]*)").findall
DIGITS = re.compile(r"\d+")
STOPS, ENDS = frozenset(".!?:;\n"), (".", "!", "?")


def plain(text: str) -> str:
    """The text without markup and without a bare prefix."""
    return PREFIX.sub("", MARKUP.sub(" ", text)).strip()


def _flat(text: str) -> bytes:
    return " ".join(WORDS(text.lower())).encode()


class Copies:
    """Tells copies of questions; holds what is made once per task."""

    def __init__(self) -> None:
        import zstandard as zstd

        self.zstd = zstd
        self.slim = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.alone = zstd.ZstdCompressor(level=LEVEL, **self.slim)

    def share(self, question: bytes, answer: bytes) -> float:
        """Compressed size of the answer given the question, as a share of that without; 0 for the same words.

        The frame of a compressed text outweighs a short question, so the same words, of any
        length, are known before anything is compressed.
        """
        if not answer or not question:
            return 1.0
        if question == answer:
            return 0.0
        given = self.zstd.ZstdCompressionDict(question, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        with_it = self.zstd.ZstdCompressor(level=LEVEL, dict_data=given, **self.slim).compress(answer)
        return max(len(with_it) - 8, 1) / max(len(self.alone.compress(answer)) - 8, 1)


_COMMON: dict[str, list[str]] = {}
for _k, _v in LANGUAGES.items():
    for _w in _v.split():
        _COMMON.setdefault(_w, []).append(_k)


def language(text: str) -> str | None:
    """The language whose common words the text has most of; None where too few tell it."""
    words = WORDS(text.lower())
    found = dict.fromkeys(LANGUAGES, 0)
    for w, n in Counter(words).items():
        for k in _COMMON.get(w, ()):
            found[k] += n
        if not w.isascii() and VIETNAMESE.search(w):
            found["vi"] += n
    best = max(found, key=found.get)
    return best if found[best] >= max(2, len(words) / 12) else None


def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(phrase, phrase)
    made.make_automaton()
    return made


class Refusals:
    """Tells answers whose first sentence that says anything declines to answer."""

    def __init__(self) -> None:
        self.refusals, self.courtesies = _automaton(REFUSALS), _automaton(COURTESIES)

    def __call__(self, question: str, answer: str) -> bool:
        """Sentences that only greet, thank, apologise or repeat the question are passed over."""
        flat = " ".join(answer.lower().split())
        if next(self.refusals.iter(flat), None) is None:
            return False
        asked = None
        for sentence in re.split(r"(?<=[.!?])\s+", flat):
            if next(self.refusals.iter(sentence), None) is not None:
                return True
            if next(self.courtesies.iter(sentence), None) is None:
                asked = asked if asked is not None else set(WORDS(question.lower()))
                if not asked.issuperset(WORDS(sentence)):
                    return False
        return False


def contexts(text: str) -> list[tuple[str, bool]]:
    """Each pair of adjacent words of a clause with whether a sentence ends after it."""
    out, last, gap = [], None, ""
    for word, after in SPOKEN(DIGITS.sub("0", text.lower())):
        if last is not None and (gap == " " or not STOPS.intersection(gap)):
            out.append((f"{last} {word}", after[:1] in ENDS))
        last, gap = word, after
    return out


def _spaced(text: str) -> str:
    """Runs of white space as one line end or one blank."""
    return re.sub(r"[^\S\n]+", " ", re.sub(r"\s*\n\s*", "\n", text)).strip()


def _without_closing(body: str) -> str:
    """The text before a closing formula or source note at its end; the text itself where there is none.

    With single blanks, either takes up at most 150 characters before the last word, which
    may be of any length; so nothing earlier can begin one.
    """
    last = body.rstrip(" \n.!)/")
    first = max(0, max(last.rfind(" "), last.rfind("\n")) - 150)
    at = next((m.start() for m in CLOSING_BEGINS.finditer(body, first) if CLOSING.match(body, m.start())), len(body))
    return body[:at].rstrip()


def ending(answer: str) -> tuple[str, str | None]:
    """How an answer ends, closing formulas and source notes set aside, and its last context.

    ``"cut"``: it ends in a mark of omission, a list number that nothing follows or a sign
    that something follows; ``"marked"``: it ends like a sentence; ``"bare"``: it does not.
    """
    body = _spaced(answer)
    if _omitted(body):
        return "cut", None
    for _ in range(4):
        shorter = _without_closing(body)
        if shorter == body or not shorter:
            break
        body = shorter
    if body.endswith("/."):
        body = body[:-2].rstrip()
        body = body if body.endswith((".", "!", "?")) else body + "."
    last, end = _last_word(body)
    if _omitted(body) or DANGLING.search(body, max(0, last - 3)):
        return "cut", None
    how = "marked" if SENTENCE_END.search(body, end) else "bare"
    before, word = DIGITS.sub("0", body[:last].lower()), DIGITS.sub("0", body[last:end].lower())
    start, stop = _last_word(before)
    joined = start < stop and not STOPS.intersection(before[stop:])
    return how, f"{before[start:stop]} {word}" if joined and word else None


def _last_word(text: str) -> tuple[int, int]:
    """Where the last word begins and ends; twice 0 where there is none."""
    end = len(text)
    while end and not text[end - 1].isalnum():
        end -= 1
    start = end
    while start and text[start - 1].isalnum():
        start -= 1
    return start, end


def _omitted(text: str) -> bool:
    """Whether a text ends in a mark of omission; one in brackets has at most 61 characters, the others no word."""
    return CUT_MARK.search(text, max(0, _last_word(text)[1] - 64)) is not None


class Judge:
    """The defect of one pair in consistent form, as far as the pair itself shows it."""

    def __init__(self) -> None:
        self.copies, self.refused = Copies(), Refusals()

    def __call__(self, question: str | None, answer: str | None) -> tuple[str | None, bool, str | None]:
        """(defect, whether the answer ends in a mark, last context to be asked of the model)."""
        said, asked = plain(answer or ""), question or ""
        flat = _flat(said)
        if flat.decode() in PLACEHOLDERS:
            return "empty", False, None
        if self.refused(asked, said):
            return "refusal", False, None
        if self.copies.share(_flat(asked), flat) <= COPY_SHARE:
            return "copy", False, None
        spoken, expected = language(said), language(asked)
        if spoken and expected and spoken != expected:
            return "other_language", False, None
        how, last = ending(said)
        if how == "cut" or (how == "bare" and last is None):
            return "truncated", False, None
        return None, how == "marked", last


def _passed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    judge = Judge()
    seen: Counter[str] = Counter()
    ended: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        n = len(seen)
        made = pa.RecordBatch.from_arrays(
            [
                pa.array([1] * n, pa.int32()), pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(list(seen), pa.string()),
                pa.array(list(seen.values()), pa.int64()), pa.array([ended[c] for c in seen], pa.int64()), pa.nulls(n, pa.bool_()),
            ],
            names=COLUMNS,
        )
        seen.clear()
        ended.clear()
        return made

    for batch in canonical_batches("answer", "answer")(canonical_batches("question", "question")(batches)):
        rows = []
        for question, answer in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist()):
            own = contexts(answer) if answer else []
            seen.update(c for c, _ in own)
            ended.update(c for c, end in own if end)
            defect, marked, last = judge(question, answer)
            mine = [end for c, end in own if c == last] if last else []
            rows.append((defect, xxhash.xxh3_64_intdigest(answer or "") - (1 << 63), last, len(mine), sum(mine), marked))
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(rows), pa.int32()), batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types))], names=COLUMNS
        )
        if len(seen) > FLUSH:
            yield counted()
    yield counted()


COLUMNS = ["kind", "key", "defect", "digest", "context", "n", "ended", "marked"]


def defective_pairs(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """Distinct rows (``key``, ``defect``) of the pairs whose answer is unusable.

    ``defect`` is ``empty``, ``refusal``, ``copy``, ``other_language`` or ``truncated``, the
    first of these that applies. A null answer is empty; with a null question only what
    the answer alone shows is found. A key with several rows has one row per distinct
    defect. An empty table gives no rows; other columns are left out, so none can clash.

    Texts are read once, where they lie, and are neither shuffled nor kept. An answer that
    shows no defect itself is asked of the model by its last context: how often that ends a
    sentence in the other answers, the answer's own uses and those of its exact copies left
    out. With a final mark it is broken off if others practically never end there, without
    one unless they nearly always do. The model holds all contexts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = df.select(F.col(key).alias("key"), F.col(question).cast("string").alias("question"), F.col(answer).cast("string").alias("answer"))
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)
    schema = f"kind int, key {kind.simpleString()}, defect string, digest bigint, context string, n bigint, ended bigint, marked boolean"
    parts = cut(rows.mapInArrow(lambda batches: _passed(batches, arrow), schema))
    model = parts.filter("kind = 1").groupBy("context").agg(F.sum("n").alias("all_n"), F.sum("ended").alias("all_ended"))
    asked = parts.filter("kind = 0 and defect is null and context is not null")
    # Exact copies are one row here, and so are all that a hot context has of them.
    answers = asked.groupBy("context", "digest", "marked").agg((F.count("*") * F.max("n")).alias("n"), (F.count("*") * F.max("ended")).alias("ended"))
    others, ends = F.col("all_n") - F.col("n"), F.col("all_ended") - F.col("ended")
    answers = answers.join(model, "context", "left").fillna(0, ["all_n", "all_ended"])
    broken = answers.filter(
        F.when(F.col("marked"), (others >= 1 / LEAST_END) & (ends < LEAST_END * others)).otherwise(~((others >= SURE_SEEN) & (ends >= SURE_END * others)))
    )
    late = asked.join(broken.select("digest").distinct(), "digest", "left_semi").withColumn("defect", F.lit("truncated"))
    return (
        parts.filter("kind = 0 and defect is not null").select("key", "defect")
        .unionByName(late.select("key", "defect"))
        .distinct()
        .select(F.col("key").alias(key), "defect")
    )
