"""Tokens, candidates, filters and offsets against plain sequential versions, and small golden cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.functions import expressions as E
from clausewright.functions import policy, tokens
from clausewright.operators import detect, evaluate, filters, match, rules, spdx

FP = rules.FALSE_POSITIVE


def _plain_states(rows):
    """Every step over all rows, without running maxima or breaks. rows: (start, end, rule, expression, flags), in order."""
    state = ["active"] * len(rows)
    overlap = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0]))
    active = lambda upto=None: [k for k in range(len(rows) if upto is None else upto) if state[k] == "active"]

    def contain(mark):
        for i, row in enumerate(rows):
            if state[i] == "active" and any(rows[k][1] >= row[1] for k in active(i)):
                state[i] = mark

    def restore(mark):
        back = [i for i, row in enumerate(rows) if state[i] == mark and not any(overlap(rows[k], row) for k in active())]
        for i in back:
            state[i] = "active"

    contain("contained")
    last = None
    for i, a in enumerate(rows):
        if state[i] != "active":
            continue
        for j in range(i + 1, len(rows)):
            b = rows[j]
            shared = overlap(a, b)
            if state[j] != "active" or not shared or (a[4] & FP and b[4] & FP):
                continue
            la, lb = a[1] - a[0], b[1] - b[0]
            goes = None
            for share in (0.9, 0.7, 0.4):
                if share == 0.4 and a[3] != b[3]:
                    continue
                if share == 0.4:
                    if shared / la >= 0.4 or shared / lb >= 0.4:
                        goes = j if la >= lb else i
                elif shared / lb >= share and la >= lb:
                    goes = j
                elif shared / la >= share and la <= lb:
                    goes = i
                if goes is not None:
                    break
            if goes is None and last is not None and not overlap(last, b) and overlap(a, last) + shared >= 0.9 * la:
                goes = i
            if goes is not None:
                state[goes] = "overlapping"
            if goes == i:
                break
        if state[i] == "active":
            last = a
    restore("contained")
    restore("overlapping")
    contain("final")
    return ["final" if s == "active" and r[4] & FP else s for s, r in zip(state, rows, strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 9), st.integers(0, 4), st.sampled_from("xyz"), st.sampled_from([2, 4, FP])), max_size=14))
def test_fold_against_plain(items):
    rows = sorted({(s, s + n, r, e, f) for s, n, r, e, f in items}, key=lambda r: (r[0], r[0] - r[1], r[2]))
    assert filters.fold(rows) == _plain_states(rows)


@pytest.mark.parametrize(
    "spans, gone",
    [
        ([(0, 6, "a"), (2, 4, "b"), (8, 10, "c")], {1}),  # contained
        ([(0, 10, "a"), (3, 12, "b")], {1}),  # 7 of 9 words, the first as long or longer
        ([(0, 9, "a"), (2, 12, "b")], {0}),  # 7 of 9 words, the second longer
        ([(0, 10, "a"), (6, 16, "a")], {1}),  # 0.4 of one licence
        ([(0, 10, "a"), (6, 16, "b")], set()),  # of two licences
        ([(0, 10, "a"), (5, 15, "b"), (10, 20, "c")], {1}),  # both neighbours together cover it
    ],
)
def test_thresholds(spans, gone):
    rows = [(s, e, k, x, 4) for k, (s, e, x) in enumerate(spans)]
    assert {k for k, s in enumerate(filters.fold(rows)) if s != "active"} == gone


def test_false_positives_leave_each_other():
    assert filters.fold_overlaps([(0, 10, 0, "", FP), (1, 11, 1, "", FP)]) == ["active", "active"]


DICTIONARY = [("a.RULE", "one", "red blue", 4, 90), ("b.RULE", "two", "blue green+ red", 16, 80), ("c.RULE", "one", "red", 64, 70), ("d.RULE", "", "green+ blue", FP, 0), ("e.RULE", "three", "red blue green+ red red", 2, 100), ("f.RULE", "four", "red blue", 16, 60)]


def _dictionary(spark):
    return rules.prepare(spark.createDataFrame(DICTIONARY, "rule_id string, expression string, text string, flags int, relevance int"), {"one": "One"})


def _words(text):
    """(word, start, end) in bytes, character by character."""
    out, at = [], 0
    while at < len(text):
        if not text[at].isalnum():
            at += 1
            continue
        end, plus = at + 1, False
        while end < len(text) and (text[end].isalnum() or (text[end] == "+" and not plus)):
            plus |= text[end] == "+"
            end += 1
        out.append((text[at:end].lower(), len(text[:at].encode()), len(text[:end].encode())))
        at = end
    return out


@pytest.mark.parametrize("method", ["seed", "automaton"])
def test_matches_against_plain(spark, method):
    rng = random.Random(9)
    parts = ["red", "Blue", "GREEN+", "é", "x", "🎉", "green"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", "--"]) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += ["", None, "red BLUE", " Red\tblue! ", "green+ blue", "++red", "x " * 1500 + "red blue " * 40]
    expected = set()
    for doc, text in enumerate(texts):
        words = _words(text or "")
        found = [(s, s + len(p), k, e, f) for k, (_, e, t, f, _) in enumerate(DICTIONARY) for p in [[w for w, *_ in _words(t)]] for s in range(len(words) - len(p) + 1) if [w for w, *_ in words[s : s + len(p)]] == p]
        whole = [r for r in found if r[1] - r[0] == len(words)]
        rows = sorted(whole or found, key=lambda r: (r[0], r[0] - r[1], r[2]))
        for (s, e, k, *_), state in zip(rows, _plain_states(rows), strict=True):
            if state == "active":
                expected.add((doc, DICTIONARY[k][0], "hash" if whole else "exact", words[s][1], words[e - 1][2], (text.encode()[words[s][1] : words[e - 1][2]]).decode()))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = detect.rule_matches(docs, _dictionary(spark), method=method, matched_text=True)
    assert {tuple(r) for r in found.select("doc_id", "rule_id", "method", "start", "end", "matched").collect()} == expected
    assert {m for *_, m, _, _, _ in expected} == {"hash", "exact"}


def test_no_shuffle_and_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "red blue")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    found = match.located(filters.filter_hits(match.hits(spark.read.parquet(f"{tmp_path}/d"), _dictionary(spark)), _dictionary(spark)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "regexp_extract_all" in plan


def test_limit_of_candidates(spark):
    docs = spark.createDataFrame([(1, "red, " * 5), (2, "red, " * 6)], "doc_id long, text string")
    found = match.hits(docs, _dictionary(spark))
    assert [tuple(r) for r in match.over_limit(found, 5).collect()] == [(2, 6)]
    assert [r["doc_id"] for r in match.within_limit(found, 5).collect()] == [1]


@pytest.mark.parametrize("text, words", [("GPL++2", ["gpl+", "2"]), ("gpl-3.0+", ["gpl", "3", "0+"]), ("İ ΟΔΟΣ ς", ["i", "οδοσ", "ς"]), ("+alone", ["alone"]), ("a_b's", ["a", "b", "s"]), ("½ Ⅷ", ["½", "ⅷ"]), ("", []), (None, [])])
def test_tokens(spark, text, words):
    row = spark.createDataFrame([(text,)], "t string").select(tokens.tokens(tokens.F.col("t")).alias("w"))
    assert row.first()["w"] == words


def test_offsets_of_long_texts(spark):
    text = "é+ x, " * 3000
    rows = tokens.once(tokens.once(spark.createDataFrame([(text,)], "t string"), "parts", tokens.offsets(tokens.F.col("t"))), "sums", tokens.offsets.sums(tokens.F.col("parts")))
    ends = [e for *_, e in _words(text)]
    for n in (1, 1023, 1024, 1025, 2048, 6000):
        assert rows.select(tokens.offsets.end(tokens.F.lit(n)).alias("e")).first()["e"] == ends[n - 1]


def test_tags():
    say = lambda t: [(s, e, r.decode()) for s, e, r in spdx.tags(t.encode())]
    assert say("/* SPDX-License-Identifier: MIT */") == [(3, 31, "MIT")]
    assert say("SPDX-License-Identifer: MIT") == [(0, 27, "MIT")]
    assert say("x spdx-license-identifier:\r\nMIT") == [] and say("SPDX License Identifier: MIT") == []
    assert [r for *_, r in say("SPDX-License-Identifier: A\nSPDX-License-Identifier: B -->")] == ["A", "B"]


@pytest.mark.parametrize("text", ["", "NONE", "NOASSERTION", "MIT AND", "OR MIT", "(MIT", "MIT)", "MIT Apache-2.0"])
def test_malformed_expressions(text):
    assert E.parse(text) is None and E.rewritten(text, str.upper) == text


@pytest.mark.parametrize("ids, state", [([], "NOASSERTION"), (["mit"], "identified"), (["mit", "Free-Unknown"], "partial"), (["unknown"], "NOASSERTION")])
def test_identification(spark, ids, state):
    row = spark.createDataFrame([(ids,)], "i array<string>").select(E.identification(E.F.col("i")).alias("s"))
    assert row.first()["s"] == state == E.identify(ids)


@pytest.mark.parametrize("text, markers, crossing", [("a b", False, False), ("a\nb", False, False), ("a\n\nb", False, True), ("# a\n#\n# b", False, True), ("// a\n// b", False, False), ("a\n- b", False, False), ("a\n- b", True, True), ("# a\nb", True, True), ("|a\nb", True, True), ("a\nb |", True, True), ("- a\nb", True, False)])
def test_block_boundaries(text, markers, crossing):
    assert policy.crosses(text.encode(), 0, len(text), markers) == crossing


def test_coverage(spark):
    found = spark.createDataFrame([(1, "text", 0, 50), (1, "notice", 40, 60), (1, "reference", 60, 90), (1, "text", 85, 200), (2, "text", 0, 5)], "doc_id long, kind string, start long, end long")
    sizes = spark.createDataFrame([(1, 100), (2, 0), (3, 10)], "doc_id long, bytes long")
    assert {r["doc_id"]: r["coverage"] for r in detect.coverage(found, sizes).collect()} == {1: 75.0, 2: 0.0, 3: 0.0}


def test_profiles_in_one_pass(spark, tmp_path):
    rng = random.Random(4)
    parts = ["red", "blue", "green+", "x"]
    rows = [(i % 50 if i % 9 else None, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, dictionary = spark.read.parquet(f"{tmp_path}/d"), _dictionary(spark)
    found = evaluate.profiles(match.hits(docs, dictionary), dictionary, docs.select("doc_id", F.array(F.lit("One"), F.lit("none")).alias("expected")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 2, plan
    names = {r["rule_index"]: r["reported_expression"] for r in dictionary.collect()}
    sets = {}
    for profile, options in evaluate.PROFILES.items():
        for r in match.candidates(filters.filter_hits(match.hits(docs, dictionary), dictionary, options)).collect():
            sets.setdefault((profile, r["doc_id"]), set()).update({names[r["rule_index"]]} - {""})
    expected = []
    for doc, _ in rows:
        of = {p: sets.get((p, doc), set()) if doc is not None else set() for p in evaluate.PROFILES}
        expected += [(p, None if doc is None else str(doc), ["One", "none"], sorted(of[p]), sorted({"One", "none"} & of["raw"]), False) for p in of]
    got = found.select("profile", "path", "expected", F.sort_array("actual"), F.sort_array("exact_expected"), "skipped").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert len({(e[0], repr(e[3])) for e in expected}) > 2 * len(evaluate.PROFILES)


def test_tags_of_cut_texts(spark):
    rng = random.Random(6)
    pieces = ["SPDX-License-Identifier:", "spdx-LICENSE-identifer:", " MIT", "\tISC OR MIT ", "é", "\n", "\r", "*/", "-->", "ſpdx-license-identifier:", "spdx-license-", " " * 1000, "x" * 1017, "é" * 700, "MIT OR " * 150, "🎉"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += [pieces[i] + " " * n + "MIT" + pieces[0] + "ISC" for i in (0, 1) for n in range(1018, 1030)] + ["", None, pieces[0], pieces[0] * 50 + "MIT", f"{pieces[0]}MIT\n" * 300]
    resolver = E.Resolver({"mit": "mit", "isc": "isc"}, {"mit": "MIT", "isc": "ISC"})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.where("text IS NOT NULL").select("doc_id", spdx._parts(F.col("text")).alias("parts")).collect()
    found = {r["doc_id"]: list(spdx.tags_of_parts(r["parts"])) for r in rows}
    assert found == {i: list(spdx.tags(t.encode())) for i, t in enumerate(texts) if t is not None}
    assert all(sum(len(p["head"] or b"") for p in r["parts"]) <= sum(p["bytes"] for p in r["parts"]) == len(texts[r["doc_id"]].encode()) for r in rows)
    expected = sorted((i, s, e, raw.decode("utf-8", "replace")) for i, t in found.items() for s, e, raw in t if resolver.normalize(raw.decode("utf-8", "replace"))[0])
    assert sorted(tuple(r)[:4] for r in spdx.find_tags(docs, resolver).collect()) == expected and len(expected) > 300


def test_matches_with_tags_read_once_and_no_text_in_python(spark, tmp_path):
    rng = random.Random(8)
    parts = ["red", "blue", "green+", "x", "/* SPDX-License-Identifier: red blue */", "SPDX-License-Identifier: MIT\n", "SPDX-License-Identifier: red\n"]
    rows = [(i % 70 if i % 9 else None, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, dictionary = spark.read.parquet(f"{tmp_path}/d"), _dictionary(spark)
    resolver = E.Resolver({"mit": "mit", "red": "red"}, {"mit": "MIT", "red": "Red"})
    both = detect.matches(docs, dictionary, resolver)
    plan = both._jdf.queryExecution().executedPlan().toString()
    python = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(python) == 2 and not any("text#" in x for x in python) and plan.count("FileScan") == 2, plan
    found = detect.rule_matches(docs, dictionary)
    tags = spdx.find_tags(docs, resolver)
    left = spdx.drop_covered(tags, found)
    plain = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert plain(both) == sorted(plain(found) + plain(spdx.as_matches(left)))
    assert 0 < left.count() < tags.count()


def test_many_hits_at_once(spark, monkeypatch):
    monkeypatch.setattr(filters, "HITS_AT_ONCE", 5)
    docs = spark.createDataFrame([(i, "red x " * (i % 8)) for i in range(40)], "doc_id long, text string").coalesce(1)
    found = detect.rule_matches(docs, _dictionary(spark))
    assert {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()} == {i: i % 8 for i in range(40) if i % 8}
