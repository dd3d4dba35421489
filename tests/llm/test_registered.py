"""Every registered query on small tables: it runs over all of them, and its rows equal those of a plain version."""

import re

import numpy as np
import pytest

from clausewright.llm import op1_quality, op3_media, op4_secrets, op5_licences, queries, textvec

from .shared import docs, prose, rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    junk = " ".join(["$$$", "CLICK", "###", "win!!!"] * 10)
    data = [(i, f"{prose(i, 30 + i % 20)}.", f"s{i % 3}") for i in range(60)] + [(100 + i, f"{junk} {i}", "s0") for i in range(20)]
    data += [(200 + i, f"{prose(i, 20)} token = \"{'9f8e7d6c5b4a' * 2}{i:08}\" {prose(i, 9)}\nReleased under the MIT License.", "s1") for i in range(8)]
    data += [(300, None, "s2"), (None, prose(1, 30), None), (5, prose(77, 30), "s2")]
    docs(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(0, 60, 2), *range(100, 120, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"https://a.example/{i}", f"<nav>menu</nav><main>{prose(i, 9)}</main>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, np.random.default_rng(i).normal(size=64).tolist(), 0) for i in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def _texts(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.mark.parametrize("name, count", [("op2_site_templates", 12), ("op6_simhash_neardup", 91), ("op8_sharding_groups", 91), ("op7_best_fit_packing", 91), ("op9_pii_identifiers", None), ("op10_temperature_mixing", None)])
def test_runs_over_all_rows(spark, folder, name, count):
    found = queries.QUERIES[name](spark, folder).collect()
    assert found and (count is None or len(found) == count)


def test_quality_against_plain(spark, folder):
    """Counts of the hashed n-grams of each text in a dictionary, and their weights one by one."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = op1_quality.train(*op1_quality.sample(spark.read.parquet(f"{folder}/documents.parquet"), labels))
    expected = []
    for doc, text in _texts(spark, folder):
        text, score = text or "", model.bias
        words = re.findall(r"[^\W_]+", text)
        h = dict(zip(words, textvec.words([" ".join(words)], case=True)[0].tolist(), strict=True)) if words else {}
        pairs = [1 if a == b else textvec.word_ngrams(np.array([h[a], h[b]], np.uint64), np.zeros(2, int), 2)[0].tolist()[0] for a, b in zip(words, words[1:], strict=False)]
        chars = []
        for n in op1_quality.CHARS:
            for i in range(len(text) - n + 1):
                x = ord(text[i]) * 0x9E3779B1 % 2**32
                for c in text[i + 1 : i + n]:
                    x = (x ^ ord(c)) * 0x85EBCA77 % 2**32
                chars.append(x ^ x >> 15)
        for grams in ([*h_of(words, h), *pairs], chars):
            score += op1_quality.SCALE * sum(float(model.weights[g % op1_quality.DIMS]) for g in grams) / (len(grams) + op1_quality.SMOOTH)
        p = 1 / (1 + np.exp(-(model.slope * score + model.shift)))
        expected.append((doc, round(float(score), 3), "keep" if p >= op1_quality.KEEP else "review" if p >= op1_quality.REJECT else "reject"))
    found = [(r["doc_id"], round(r["score"], 3), r["verdict"]) for r in queries.QUERIES["op1_quality_rules"](spark, folder).collect()]
    order = lambda r: (repr(r[0]), r[1])
    for a, b in zip(sorted(found, key=order), sorted(expected, key=order), strict=True):
        assert a[0] == b[0] and a[2] == b[2] and a[1] == pytest.approx(b[1], abs=0.01)


def h_of(words, h):
    return [h[w] for w in words]


def test_secrets_against_plain(spark, folder):
    ratio = op4_secrets.Ratio(op4_secrets.labelled_samples())
    expected = sorted(((d, m.start(), m.end()) for d, t in _texts(spark, folder) for m in re.finditer(f"[{re.escape(op4_secrets.ALPHABET)}]+", t or "") if len(m[0]) >= op4_secrets.MIN_LENGTH and ratio.is_secret(m[0])), key=repr)
    found = rows(queries.QUERIES["op4_secret_scan"](spark, folder).select("doc_id", "start", "end"))
    assert found == expected and len({d for d, *_ in found}) == 8


def test_secret_samples_of_a_table(spark):
    table = spark.createDataFrame([(f"Qx{i}zT9v{i}", True) for i in range(50)] + [(f"name_of_{i}", False) for i in range(50)] + [(None, True), ("x", None)], "text string, is_secret boolean")
    found = op4_secrets.bounded(table, 20)
    assert len(found) == 40 and sum(s for _, s in found) == 20
    assert op4_secrets.scan(docs(spark, [(1, "see Qx77zT9v77Qx78zT9v78 here")]), table).count() == 1


def test_licences_against_plain(spark, folder):
    """Each text classified on its own."""
    model = op5_licences.train()
    expected = sorted(((d, line, s, e, f) for d, t in _texts(spark, folder) for _, line, s, e, f, _, share in op5_licences.classify([t or ""], model) if share >= op5_licences.MIN_SIMILARITY), key=repr)
    found = queries.QUERIES["op5_licence_paragraphs"](spark, folder)
    assert rows(found.where("confirmed").select("doc_id", "paragraph", "start", "end", "family")) == expected
    assert {d for d, *_, f in expected if f == "mit"} == set(range(200, 208))


def test_media_against_plain(spark, folder):
    expected = []
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        expected += [(r["vec_id"], *c[:5]) for c in op3_media.clips(op3_media.render(list(r["embedding"])))]
    assert rows(queries.QUERIES["op3_media_shots"](spark, folder).select("media_id", "shot", "first_frame", "frames", "start_s", "end_s")) == sorted(expected, key=repr)
