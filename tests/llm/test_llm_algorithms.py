import random
import unicodedata

import pytest

from quillet.llm import frequency, outranking, overlap, splits, topn
from quillet.sources.rankings import run_items

RUNS = "run_id string, qid string, slice_no int, ranked array<struct<doc_id:string,score:double>>, doc_id string"


def brute_flow(runs, threshold=0.5):
    """runs: {source: {item: score}} of one group."""
    items = sorted({i for r in runs.values() for i in r})
    n, total = len(items), dict.fromkeys(items, 0.0)
    for r in runs.values():
        key = lambda i: r.get(i, float("-inf"))
        p = {i: (sum(key(j) < key(i) for j in items) + sum(key(j) == key(i) for j in items) / 2) / n for i in items}
        pref = lambda d: max(0.0, min(1.0, d / threshold))
        f = {i: sum(pref(p[i] - p[j]) - pref(p[j] - p[i]) for j in items) / max(n - 1, 1) for i in items}
        low = min((f[i] for i in items if i not in r), default=0.0)
        for i in r:
            total[i] += f[i] - low
    return total


def test_net_flows(spark):
    rng = random.Random(4)
    groups = {}
    for g in range(12):
        groups[f"q{g}"] = {
            f"r{k}": {f"d{i}": float(rng.choice([rng.randint(0, 5), rng.random() * 10**k, 1e9])) for i in rng.sample(range(20), rng.randint(1, 15))} for k in range(3)
        }
    groups["one"] = {"r0": {"d": 1.0}}
    rows = [(g, r, i, s) for g, own in groups.items() for r, items in own.items() for i, s in items.items()]
    df = spark.createDataFrame(rows, "g string, r string, i string, s double")
    got = {(r.g, r.i): r.flow for r in outranking.net_flows(df, "g", "r", "i", "s").collect()}
    want = {(g, i): f for g, own in groups.items() for i, f in brute_flow(own).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    places = outranking.combined_ranking(outranking.net_flows(df, "g", "r", "i", "s"), "g", "i").collect()
    for g in groups:
        assert [r.i for r in sorted((r for r in places if r.g == g), key=lambda r: r.place)] == sorted({i for x, i in got if x == g}, key=lambda i: (-got[g, i], i))
    assert outranking.net_flows(df.limit(0), "g", "r", "i", "s").count() == 0
    weights = spark.createDataFrame([("r0", 1.0), ("r1", 0.0), ("r2", 0.0)], "r string, weight double")
    first = {r.i: r.flow for r in outranking.net_flows(df.filter("g = 'q0'"), "g", "r", "i", "s", weights=weights).collect()}
    assert max(first, key=lambda i: (first[i], i)) in groups["q0"]["r0"]


@pytest.mark.parametrize("large, chunk", [(300_000, 50), (0, 50), (25, 7)])
def test_run_flows(spark, monkeypatch, large, chunk):
    monkeypatch.setattr(outranking, "LARGE", large)
    monkeypatch.setattr(outranking, "CHUNK", chunk)
    rng = random.Random(14)
    nan, rows, groups = float("nan"), [], {}
    for g in range(15):
        for r in range(3):
            own = {}
            for part in range(2):
                items = [(f"d{rng.randint(0, 15)}", rng.choice([1.0, 2.0, rng.random() * 10**r, -5.0])) for _ in range(rng.randint(0, 9))]
                rows.append((f"r{r}", f"q{g}", part, [*items, (None, 9.0), ("n", nan), ("m", None)], "x"))
                for d, x in items:
                    own[d] = max(x, own.get(d, -1e9))
            if own:
                groups.setdefault(f"q{g}", {})[f"r{r}"] = own
    rows += [("r0", "q0", 0, None, "x"), (None, "q0", 0, [("d", 1.0)], "x"), ("r0", "void", 0, [], "x")] + rows[:3]
    df = spark.createDataFrame(rows, RUNS)
    got = {(r.qid, r.doc_id): r.flow for r in outranking.run_flows(df).collect()}
    want = {(g, i): f for g, own in groups.items() for i, f in brute_flow(own).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    assert outranking.run_flows(df.limit(0)).count() == 0
    weighed = {(r.qid, r.doc_id): r.flow for r in outranking.run_flows(df, weights={"r0": 2.0, "r2": 0.5}).collect()}
    factor = {"r0": 2.0, "r1": 0.0, "r2": 0.5}
    for g, own in groups.items():
        # Each source by itself, with its zero, among all items of the group.
        parts = {r: brute_flow({r: own[r], **{"other": {i: 0.0 for x in own.values() for i in x}}}) for r in own}
        level = brute_flow({"other": {i: 0.0 for x in own.values() for i in x}})
        for i in {i for x in own.values() for i in x}:
            assert weighed[g, i] == pytest.approx(sum(factor[r] * (parts[r][i] - level[i]) for r in own), abs=1e-7)


def test_top_n(spark):
    rng = random.Random(9)
    rows = [("hot", f"d{i}", float(rng.randint(0, 50))) for i in range(3000)] + [(f"g{k}", f"d{i}", rng.choice([1.0, 2.0, rng.random()])) for k in range(60) for i in range(rng.randint(1, 9))]
    rows += [(None, "a", 1.0), ("nulls", "a", None), ("nulls", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumnRenamed("s", "score")
    got = {}
    for r in topn.top_n(df, ["g"], "i", "score", 5).collect():
        got.setdefault(r.g, {})[r.place] = r.i
    for g in {r[0] for r in rows} - {"nulls"}:
        best = sorted(((-s, i) for x, i, s in rows if x == g))[:5]
        assert got[g] == {p: i for p, (_, i) in enumerate(best, 1)}
    assert "nulls" not in got and topn.top_n(df.limit(0), ["g"], "i", "score", 5).count() == 0
    scaled = topn.top_n(df.filter("g is not null"), ["g"], "i", "score", 5, scale="g")
    assert {(r.g, r.place): r.i for r in scaled.collect()} == {(g, p): i for g, own in got.items() if g for p, i in own.items()}


def test_top_n_of_runs(spark):
    """A third of all rows is one question; ties, repeats within and across slices, lists of repeats only."""
    rng = random.Random(12)
    rows = [("r", "hot", k, [(f"d{rng.randint(0, 90)}", float(rng.randint(0, 9))) for _ in range(30)]) for k in range(60)]
    rows += [(f"r{k % 3}", f"q{k // 4}", k, [(f"d{rng.randint(0, 20)}", rng.choice([1.0, -0.0, 0.0, rng.random() * 10 ** (k % 3)])) for _ in range(rng.randint(0, 12))]) for k in range(120)]
    rows += [("r", "same", 0, [("a", 3.0)] * 40 + [("b", 1.0)]), (None, "none", 0, [("a", 1.0)])]
    df = spark.createDataFrame([(*r, "x") for r in rows], RUNS)
    want = {}
    for r, q, _, items in rows:
        for d, x in items:
            own = want.setdefault((r, q), {})
            own[d] = max(x, own.get(d, -1e9))
    want = {(*g, p): d for g, own in want.items() for p, (d, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert {(r.run_id, r.qid, r.place): r.doc_id for r in topn.top_n_of_runs(df, ["run_id", "qid"], 5).collect()} == want
    assert topn.top_n_of_runs(df.limit(0), ["run_id", "qid"], 5).count() == 0


def test_wrong_cuts(spark):
    nan = float("nan")
    runs = spark.createDataFrame(
        [
            ("r", "q", 0, [("a", 1.0), ("b", 3.0), (None, 9.0), ("n", nan)], "x"), ("r", "q", 1, [("a", 5.0), ("c", 3.0)], "x"), ("r", "q", 1, [("a", 5.0), ("c", 3.0)], "x"),
            ("r", "right", 0, [("a", 1.0)], "x"), ("r", "none", 0, None, "x"), ("r", "void", 0, [], "x"), ("r", "lost", 0, [("z", 1.0)], "x"), ("r", "null", 0, [("z", 1.0)], "x"),
        ],
        RUNS,
    )
    saved = spark.createDataFrame(
        [("r", "q", ["a", "b", "c"], "2024"), ("r", "q", ["a", "c", "b"], "2025"), ("r", "right", ["z"], "2024"), ("r", "right", ["a"], "2025"), ("r", "null", None, "2025")],
        "run_id string, qid string, predicted array<string>, saved_at string",
    )
    got = {(r.qid, r.place, r.doc_id) for r in topn.wrong_cuts(runs, saved).collect()}
    assert got == {("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("lost", 1, "z"), ("null", 1, "z")}
    assert run_items(runs.limit(0), ["qid"]).count() == 0


def brute_groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r, e in pairs:
        if r is not None and e is not None:
            root[find(("r", r))] = find(("e", e))
    out = {}
    for r in {r for r, e in pairs if r is not None and e is not None}:
        out.setdefault(find(("r", r)), []).append(r)
    return {r: min(own) for own in out.values() if len(own) > 1 for r in own}


@pytest.mark.parametrize("small", [0, 200_000])
def test_groups(spark, monkeypatch, small):
    rng = random.Random(11)
    monkeypatch.setattr(splits, "DEGREE", 5)
    pairs = [(f"q{rng.randint(0, 300)}", f"e{rng.randint(0, 260)}") for _ in range(260)]
    pairs += [(f"c{i}", f"x{i}") for i in range(40)] + [(f"c{i + 1}", f"x{i}") for i in range(40)]  # a long chain
    pairs += [(f"h{i}", "hot") for i in range(60)] + [(None, "hot"), ("z", None), ("h1", "hot")]
    df = spark.createDataFrame(pairs, "qid string, e string")
    if small == 0:
        monkeypatch.setattr(splits, "SMALL", 30)
    got = {r.qid: r.group for r in splits.groups(df, "qid", "e").collect()}
    assert got == brute_groups(pairs)
    if small:
        assert splits.groups(df.limit(0), "qid", "e").count() == 0


def test_assigned_splits(spark):
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = [(f"q{i}", f"g{i // 3}") for i in range(1800)] + [(f"b{i}", "big") for i in range(900)]
    records = spark.createDataFrame([(q,) for q, _ in rows] + [(f"s{i}",) for i in range(300)] + [(None,), ("q1",)], "qid string")
    grouped = spark.createDataFrame(rows, "qid string, group string")
    made = {r.qid: r.split for r in splits.assign_splits(records, "qid", grouped, shares).collect()}
    assert len(made) == 3000
    for g in {g for _, g in rows}:
        assert len({made[q] for q, x in rows if x == g}) == 1
    for s, share in shares.items():
        assert abs(sum(v == s for v in made.values()) / 3000 - share) < 0.01
    assert splits.assign_splits(records.limit(0), "qid", grouped, shares).count() == 0


def test_terms(spark):
    nfd = unicodedata.normalize("NFD", "Luật")
    rows = [("1", "Luật luật, đất!", 1), ("2", nfd + " A​B", 1), ("3", "thuế", 1), ("3", "thuế THUẾ luật", 2), ("4", None, 1), ("5", "...", 1), (None, "luật", 1), ("6", "đất luật", 1), ("6", "đất luật", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, v int")
    got = {r.term: (r.uses, r.docs, r.mark) for r in frequency.marked_terms(df, "doc_id", "text", "v").collect()}
    assert got == {"luật": (5, 4, "common"), "đất": (2, 2, "rare"), "ab": (1, 1, "rare"), "thuế": (2, 1, "rare")}
    assert frequency.marked_terms(df.limit(0), "doc_id", "text", "v").count() == 0


def test_heavy_terms_do_not_change_counts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(str(i), " ".join(rng.choice(["a", "b", f"w{rng.randint(0, 400)}"]) for _ in range(20))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    first = {tuple(r) for r in frequency.marked_terms(df, "doc_id", "text").collect()}
    monkeypatch.setattr(frequency, "MAX_HEAVY", 0)
    monkeypatch.setattr(frequency, "FLUSH", 10)
    assert {tuple(r) for r in frequency.marked_terms(df, "doc_id", "text").collect()} == first


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[i] = f"z{rng.randint(0, 999)}"
        elif kind == 1 and len(words) > 2:
            del words[i]
        else:
            words.insert(i, f"y{rng.randint(0, 999)}")
    return words


def test_edit_distances():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert overlap.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("spare, most", [(32, 1 << 29), (1, 1 << 15)])
def test_bitmaps_lose_nothing(spark, monkeypatch, spare, most):
    """A third of all rows hold one text; a bitmap that is full only stops fewer buckets."""
    monkeypatch.setattr(overlap, "SPARE", spare)
    monkeypatch.setattr(overlap, "MOST_BITS", most)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d e f g h i k l m n o p q".split()) + str(rng.randint(0, 30)) for _ in range(20)) for _ in range(200)]
    left = [(f"l{i}", texts[0] if i % 3 == 0 else texts[i]) for i in range(150)]
    right = [(f"r{i}", texts[0] if i % 3 == 0 else texts[(i + 7) % 200]) for i in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "qid string, text string")
    got = {tuple(r) for r in overlap.overlapping_records(frame(left), frame(right), "qid", "text").collect()}
    assert got == {(a, b) for a, x in left for b, y in right if x == y}


def test_overlaps(spark):
    rng = random.Random(8)
    vocabulary = [f"từ{i}" for i in range(300)]
    train = {f"t{i}": " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 45))) for i in range(300)}
    dev = {f"d{i}": " ".join(edits(rng, train[f"t{i}"].split(), rng.randint(0, 8))) for i in range(150)}
    train["copy"] = train["t0"].upper() + "!!"
    dev["spaced"] = train["t1"].replace(" ", "", 3)
    rows = lambda own: spark.createDataFrame([(k, v, "s") for k, v in own.items()] + [("null", None, "s"), ("blank", " ​", None), ("mark", "?!", None)], "qid string, text string, class string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = {k: overlap.words_of(v) for k, v in {**train, **dev}.items()}
    want = {(a, b) for a in dev for b in train if 8 * distance(words[a], words[b]) <= max(len(words[a]), len(words[b])) or "".join(words[a]) == "".join(words[b])}
    pairs = overlap.overlapping_records(rows(dev), rows(train), "qid", "text")
    got = {tuple(r) for r in pairs.collect()}
    assert len(want - got) <= 0.005 * len(want) and got <= want
    report = overlap.overlap_report(pairs, rows(dev), rows(train), "qid", "class", ("dev", "train")).collect()
    assert {r.split: r.pairs for r in report} == {"dev": len(got), "train": len(got)}
    assert overlap.overlapping_records(rows(dev).limit(0), rows(train), "qid", "text").count() == 0


def test_queries_and_sql(spark, data):
    from quillet.llm import queries

    made = queries.queries()
    assert set(queries.oracle_sql()) <= set(made)
    columns = {"p1_found": ["qid", "doc_id"], "p7_found": ["run_id", "qid", "place", "doc_id"], "p10_found": ["doc_id", "subject"], "p8_ids": ["doc_id", "ids"], "p6_found": ["qid_a", "qid_b"]}
    for name, own in columns.items():
        df = made[name](spark, data)
        assert df.columns == own
        if name != "p8_ids":
            assert df.count() == df.distinct().count()
