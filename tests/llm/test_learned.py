"""Operators that learn: held-out accuracy, calibration and planted cases."""

import random
import re
import time

import numpy as np
import pytest

from clausewright.llm import linear, op1_quality, op4_secrets, op5_licences, op9_pii, textvec

from .shared import docs, prose, rows


def _labelled(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    rng = random.Random(seed)
    good = [prose(rng.random(), rng.randint(20, 200)) + "." for _ in range(n)]
    junk = [" ".join(rng.choice(["$$$", "CLICK", "###", "win!!!", "zxq", "00000"]) for _ in range(rng.randint(20, 200))) for _ in range(n)]
    return good + junk, np.array([1] * n + [0] * n)


def test_quality_held_out_accuracy():
    texts, y = _labelled(60, 1)
    order = np.random.default_rng(0).permutation(len(y))
    model = op1_quality.train([texts[i] for i in order], y[order], {0: 60, 1: 60})
    new, truth = _labelled(40, 2)
    p = model.probability(op1_quality.scores(new, model.weights, model.bias))
    assert ((p >= 0.5) == (truth == 1)).mean() > 0.97


def test_quality_scores_equal_feature_rows():
    texts = ["", "one two two three", prose(5, 50_000), "日本 語"]
    w = np.random.default_rng(1).normal(size=op1_quality.DIMS).astype(np.float32)
    assert np.allclose(op1_quality.scores(texts, w, 0.5), op1_quality.features(texts).dot(w[:, None])[:, 0] + 0.5, atol=1e-3)


def test_word_hashes_against_plain_python():
    texts = ["Ab ab, x1-y2", "", "ÄÖ äö", prose(6, 40_000)]
    h, owner, start, end = textvec.words(texts)
    found = [(o, texts[o][s:e].lower()) for o, s, e in zip(owner, start, end, strict=True)]
    assert found == [(i, w.lower()) for i, t in enumerate(texts) for w in re.findall(r"[^\W_]+", t)]
    by: dict = {}
    for (_, w), x in zip(found, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_binary_fit_equals_two_columns():
    rng = np.random.default_rng(3)
    r = linear.Rows(rng.integers(0, 50, 600), rng.random(600), np.repeat(np.arange(100), 6), 100)
    y = rng.integers(0, 2, 100)
    w, b = linear.fit(r, y, 2, 50, steps=30)
    assert np.allclose(w[:, 0], -w[:, 1]) and b[0] == -b[1]
    p = linear._softmax(r.dot(w) + b)
    assert (p.argmax(axis=1) == y).mean() > 0.6


def test_platt_is_calibrated():
    rng = np.random.default_rng(4)
    s = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(3 * s - 1)))).astype(int)
    a, c = linear.platt(s, y, np.ones(len(s)))
    assert abs(a - 3) < 0.2 and abs(c + 1) < 0.1


def test_secrets_held_out():
    ratio = op4_secrets.Ratio(op4_secrets.labelled_samples(seed=5))
    held = [(t, s) for t, s in op4_secrets.labelled_samples(n=1000, seed=99) if len(t) >= op4_secrets.MIN_LENGTH]
    assert np.mean([ratio.is_secret(t) == s for t, s in held]) > 0.97


def test_secrets_found_in_whole_text(spark):
    secret = "ghp_x8Kq2LmZ9vT4bN7wR1sY5dF3hJ6pQ0cA"
    text = prose(1, 20_000) + f" token={secret} " + "international_development_responsibility"
    found = op4_secrets.scan(docs(spark, [(1, text), (2, None)])).collect()
    assert [r["doc_id"] for r in found] == [1]
    assert secret in text[found[0]["start"] : found[0]["end"]]
    with pytest.raises(ValueError):
        op4_secrets.Ratio([("abc", True)])


@pytest.fixture(scope="module")
def licences():
    return op5_licences.train()


def test_licences(spark, licences):
    texts, labels = op5_licences.samples(15, seed=77)
    right = wrong = 0
    for t, k in zip(texts, labels, strict=True):
        families = [f for *_, f, _, share in op5_licences.classify([t], licences) if share >= op5_licences.MIN_SIMILARITY]
        right += families == ([] if k == len(op5_licences.FAMILIES) - 1 else [op5_licences.FAMILIES[k]])
        wrong += bool(families) and k == len(op5_licences.FAMILIES) - 1
    assert right / len(texts) > 0.85 and wrong / len(texts) < 0.01
    text = prose(1, 5_000) + "\n\nReleased under the MIT License.\n\n" + prose(2, 50)
    found = [r for r in op5_licences.scan(docs(spark, [(1, text), (2, "The fishing license is valid for one year.")]), licences).collect() if r["confirmed"]]
    assert [(r["doc_id"], r["paragraph"], r["family"], text[r["start"] : r["end"]]) for r in found] == [(1, 1, "mit", "under the MIT License")]


HEADER = """#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
x = 1"""


def test_wrapped_notices_are_seen_whole(licences):
    found = [r for r in op5_licences.classify([HEADER], licences) if r[6] >= op5_licences.MIN_SIMILARITY]
    assert found and found[0][4] == "gpl-3.0" and found[0][1] == 0
    assert HEADER[found[0][2] : found[0][3]].startswith("it under the terms") and "Foundation" in HEADER[found[0][2] : found[0][3]]


@pytest.mark.parametrize("family, line", [("apache-2.0", "Licensed under the Apache License, Version 2.0."), ("mit", "Released under the MIT License."), ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."), ("mpl-2.0", "These files are under the Mozilla Public License, version 2.0")])
def test_lines_within_prose(licences, family, line):
    for k in range(8):
        text = f"{prose(k, 5 * k)}\n{line}\n{prose(k + 9, 40)}"
        assert [r[4] for r in op5_licences.classify([text], licences) if r[6] >= op5_licences.MIN_SIMILARITY] == [family]


def test_two_notices_in_one_paragraph(licences):
    found = op5_licences.classify([f"Released under the MIT License. {prose(2, 10)} and under the Apache License, Version 2.0, as you like"], licences)
    assert {r[4] for r in found if r[6] >= op5_licences.MIN_SIMILARITY} == {"mit", "apache-2.0"}


def test_windows_against_plain(licences):
    """The probabilities of each window, one at a time and in plain Python."""
    text = f"{prose(3, 30)} under the terms of the MIT license {prose(4, 20)}\n\n{HEADER}"
    grams = lambda words, n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes, *_ = textvec.words([text])
    words = hashes.tolist()
    bucket = {}
    for n in (1, 2, 3):
        h, _ = textvec.word_ngrams(hashes, np.zeros(len(hashes), int), n)
        bucket.update(zip(grams(words, n), (h % np.uint64(op5_licences.DIMS)).astype(int).tolist(), strict=True))
    plain, at, line = [], 0, []
    for k, part in enumerate(op5_licences._BLANK_LINE.split(text)):
        n = len(textvec.words([part])[0])
        mine = words[at : at + n]
        line += [k] * n
        at += n
        for low in range(0, max(1, -(-(n - op5_licences.WINDOW) // op5_licences.STRIDE) * op5_licences.STRIDE + 1), op5_licences.STRIDE):
            features = [bucket[g] for k in (1, 2, 3) for g in grams(mine[low : low + op5_licences.WINDOW], k)]
            logits = licences.bias + op5_licences.SCALE * licences.weights[features].sum(axis=0) / (len(features) + op5_licences.SMOOTH)
            plain.append(licences.probabilities(logits[None])[0])
    *_, p = op5_licences.windows(hashes, np.zeros(len(hashes), int), np.array(line), licences)
    assert at == len(words) and p.shape == (len(plain), len(op5_licences.FAMILIES)) and np.allclose(p, plain, atol=1e-4)


def test_labelled_rows_of_a_table(spark):
    table = spark.createDataFrame([(f"{prose(i, 4)} zork terms {prose(i, 3)}", "isc") for i in range(30)] + [("x", None), (None, "mit"), ("y", "no such")], "text string, family string")
    texts, labels = op5_licences.bounded(table, 20)
    assert len(texts) == 22 and sorted(np.unique(labels).tolist()) == [op5_licences.FAMILIES.index("isc"), len(op5_licences.FAMILIES) - 1]


def test_markov_against_plain():
    """Interpolated probabilities of orders 2, 1 and 0 by counting in dictionaries."""
    texts = ["getUserName", "set_value", "ab/cd-ef", "aaaa"]
    model = op4_secrets.Markov(texts, 3.0)
    n = len(op4_secrets.ALPHABET)
    three, two, one = {}, {}, {}
    for t in texts:
        for a, b, c in zip("^^" + t, "^" + t, t, strict=False):
            for d, k in ((three, (a, b, c)), (two, (b, c)), (one, c)):
                d[k] = d.get(k, 0) + 1
    total = sum(one.values())

    def p(a, b, c):
        p0 = (one.get(c, 0) + 0.5) / (total + 0.5 * n)
        p1 = (two.get((b, c), 0) + 3 * p0) / (sum(v for k, v in two.items() if k[0] == b) + 3)
        return (three.get((a, b, c), 0) + 3 * p1) / (sum(v for k, v in three.items() if k[:2] == (a, b)) + 3)

    code = {c: i for i, c in enumerate(op4_secrets.ALPHABET)} | {"^": n}
    for a, b, c in [("^", "^", "g"), ("^", "g", "e"), ("s", "e", "t"), ("z", "z", "z"), ("a", "a", "a")]:
        assert model.log_p[code[a], code[b], code[c]] == pytest.approx(np.log(p(a, b, c)), abs=1e-4)
    ratio = op4_secrets.Ratio([("Zq9xT1", True), ("name", False)])
    r, o = op4_secrets.Markov(["Zq9xT1"]).log_p, op4_secrets.Markov(["name"]).log_p
    plain = sum(r[code[a], code[b], code[c]] - o[code[a], code[b], code[c]] for a, b, c in zip("^^nZ9", "^nZ9", "nZ9e", strict=False))
    assert ratio("nZ9e") == pytest.approx(plain, abs=1e-4)


def _people(n: int) -> list[tuple]:
    rng = random.Random(8)
    out = []
    for i in range(n):
        phone = f"+44 20 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}"
        out.append((i, f"{prose(i, 10)} please call {phone} today. Write to user{i}@example.org soon. {prose(i + n, 10)}"))
    # no validator knows these: only their context tells
    return [*out, (1000, f"{prose(5, 8)} please call 5550 1234 88 today. {prose(6, 8)}"), (1001, f"{prose(7, 30)} built in 12345678 pieces")]


def test_pii_bootstraps_from_context(spark):
    found = op9_pii.find(docs(spark, _people(30))).collect()
    by = {(r["doc_id"], r["type"]): r for r in found}
    assert all((i, t) in by for i in range(30) for t in ("phone", "email"))
    assert not by[1000, "phone"]["is_seed"] and (1001, "phone") not in by


def test_pii_scores_against_plain_python(spark):
    people = _people(12)
    got = {(r["instance"], r["type"]): r["score"] for r in op9_pii.score(op9_pii.occurrences(docs(spark, people))).collect()}
    edges, seeds = set(), {}
    for _, text in people:
        for _, _, value, seed, patterns in op9_pii.candidates(text):
            edges |= {(value.lower(), p) for p in patterns}
            if seed:
                seeds[value.lower()] = min(seed, seeds.get(value.lower(), seed))
    known = {v: (t, 1.0) for v, t in seeds.items()}
    for _ in range(op9_pii.ROUNDS):
        mass, every = {}, {}
        for v, p in edges:
            every[p] = every.get(p, 0) + 1
            if v in known:
                mass.setdefault(p, {}).setdefault(known[v][0], []).append(known[v][1])
        trust = {}
        for p, types in mass.items():
            total = sum(map(sum, types.values()))
            for t, m in types.items():
                c = sum(m) / (total + op9_pii.UNKNOWN * max(0, every[p] - total))
                if t != "other" and sum(m) >= op9_pii.SUPPORT and c >= op9_pii.PATTERN_MIN:
                    trust[p, t] = c
        fresh = {}
        for v, p in edges:
            for t in op9_pii.TYPES:
                if v not in seeds and (p, t) in trust:
                    fresh.setdefault(v, {}).setdefault(t, []).append(1 - min(trust[p, t], 1 - 1e-9))
        known = {v: (t, 1.0) for v, t in seeds.items()}
        for v, types in fresh.items():
            known[v] = max(((t, 1 - float(np.prod(d))) for t, d in types.items()), key=lambda x: x[1])
    assert sorted(round(s, 6) for s in got.values()) == sorted(round(s, 6) for _, s in known.values())


def test_mask_replaces_only_identifiers(spark):
    d = docs(spark, _people(30))
    before = dict(rows(d.select("doc_id", "text")))
    after = dict(rows(op9_pii.mask(d).select("doc_id", "text")))
    assert "user3@example.org" not in after[3] and "<EMAIL>" in after[3] and "<PHONE>" in after[3]
    assert after[1001] == before[1001]
    assert after[3].startswith(before[3][:20])


def test_shape_alone_makes_no_card(spark):
    rng = random.Random(11)

    def number(good: bool) -> str:
        while True:
            n = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if op9_pii.luhn(n) == good:
                return n

    people = [(i, f"{prose(i, 9)} {number(i % 2 == 0)} {prose(i + 500, 9)}") for i in range(60)]
    found = op9_pii.find(docs(spark, people)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(0, 60, 2)) and {r["type"] for r in found} == {"card"}
    tokens = [(i, f'token = "{rng.getrandbits(128):032x}"') for i in range(20)] + [(100 + i, f"{prose(i, 9)} {rng.getrandbits(128):032x} {prose(i + 900, 9)}") for i in range(5)]
    assert {r["doc_id"] for r in op9_pii.find(docs(spark, tokens)).collect()} == set(range(20))


def test_credentials_assigned_without_blanks(spark):
    value, letters, padded = "wJalrXUtnFEMIbKDENGbPxRfiCY9EXAMPLE1", "correcthorsebatterystaple", "aGVsbG8gd29ybGQhISEhIQ=="
    texts = [f"AWS_SECRET_ACCESS_KEY={value}", f"export password={letters}\n", f'token = "{letters}"', f"api_key={padded} and more", f"https://example.org/?user=me&token={value}&x=y", f"see {letters} here", f"NAME={value}"]
    found = {r["doc_id"]: texts[r["doc_id"]][r["start"] : r["end"]] for r in op9_pii.find(docs(spark, list(enumerate(texts)))).collect() if r["type"] == "credential"}
    assert found == {0: value, 1: letters, 2: letters, 3: padded, 4: value}
    assert dict(rows(op9_pii.mask(docs(spark, list(enumerate(texts)))).select("doc_id", "text")))[1] == "export password=<CREDENTIAL>\n"


def _plain_mask(text, found):
    for start, end, kind in sorted(found, reverse=True):
        text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
    return text


@pytest.mark.parametrize("limit", [0, 200_000])
def test_mask_against_plain(spark, monkeypatch, limit):
    monkeypatch.setattr(op9_pii, "BROADCAST_ROWS", limit)
    data = [(i, f"{prose(i, 8)} mail someone{i}@example.org 🎉 or call +49 (30) 1234 {1000 + i} now; token = \"{'ab12' * 5}{i}\" {prose(i + 1, 5)}") for i in range(30)] + [(40, prose(4, 10)), (None, "é x@y.example"), (41, "a@b.cc " * 2000)]
    d = docs(spark, data)
    spans = {}
    for r in op9_pii.find(d).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["type"]))
    assert len(spans[41]) == 2000
    assert rows(op9_pii.mask(d).select("doc_id", "text")) == sorted(((i, _plain_mask(t, spans.get(i, []))) for i, t in data), key=repr)


def test_candidates_of_any_script_reach_the_operator(spark):
    number = "+٤٩ ٣٠ ١٢٣٤ ٥٦٧٨"
    assert [c[2] for c in op9_pii.candidates(f"tel {number} .")] == [number]
    assert op9_pii.occurrences(docs(spark, [(1, f"tel {number} .")])).count() == 1


def test_addresses_come_first():
    values = lambda t: [c[2] for c in op9_pii.candidates(t)]
    assert values("to a.b@c.org, x@y.net;bob@z.com (q@r.de)") == ["a.b@c.org", "x@y.net", "bob@z.com", "q@r.de"]
    assert values("1234567 8901234-bob@x.com") == ["1234567", "8901234-bob@x.com"]
    assert values("a@b@c.org @ b@ @c") == ["a@b"]
    for t in ("4111 1111 1111 1111 me@x.org 192.168.0.1", "me@x.org,+1 (555) 123 4567"):
        assert len(values(t)) == len(re.split(r" me|,| (?=192)", t))


@pytest.mark.parametrize("part", ["漢字", "a", "1", "1 ", "a1", "1.", "@", "a@", "+1 ", "1-", "(1) ", "_=", "token=", "é@é "])
def test_long_texts_take_linear_time(part):
    began = time.process_time()
    sum(1 for _ in op9_pii.candidates(part * ((1 << 18) // len(part))))
    assert time.process_time() - began < 20  # seconds for 256 kB
