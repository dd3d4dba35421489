"""Every text operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest

from clausewright.llm import op1_quality, op4_secrets, op5_licences, op6_neardup, op7_packing, op8_sharding, op9_pii, op10_mixing

from .shared import DOCS, docs, hard_rows, prose, rows, with_extra

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def licence_model():
    return op5_licences.train(n=60, steps=20)


@pytest.fixture(scope="module")
def operators(spark, licence_model):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 0), (99, 0, 0), (4, None, None), (6, 7, 0)], LABELS)
    return {
        "quality": (lambda d: op1_quality.quality_rules(d, labels), 11),
        "keep_good": (lambda d: op1_quality.keep_good(d, labels), None),
        "secrets": (op4_secrets.scan, 0),
        "licences": (lambda d: op5_licences.scan(d, licence_model), None),
        "groups": (op6_neardup.groups, 11),
        "drop_copies": (op6_neardup.drop_copies, 9),
        "packing": (op7_packing.pack, None),
        "sharding": (op8_sharding.shard, 11),
        "identifiers": (op9_pii.find, 0),
        "mask": (op9_pii.mask, 11),
        "mixing": (op10_mixing.mix, None),
        "drawn": (op10_mixing.drawn, None),
    }


NAMES = ["quality", "keep_good", "secrets", "licences", "groups", "drop_copies", "packing", "sharding", "identifiers", "mask", "mixing", "drawn"]


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows_and_extra_columns(spark, operators, name):
    f, n = operators[name]
    plain = docs(spark, hard_rows())
    found = rows(f(plain))
    if n is not None:
        assert len(found) == n
    extra = f(with_extra(plain))
    assert rows(extra.select(*f(plain).columns)) == found


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, operators, name):
    f, _ = operators[name]
    assert rows(f(spark.createDataFrame([], DOCS))) == []


@pytest.mark.parametrize("name", NAMES)
def test_only_nulls(spark, operators, name):
    f, _ = operators[name]
    none = spark.createDataFrame([(None,) * 5, (None,) * 5], DOCS)
    kept = {"quality": 2, "keep_good": 2, "groups": 2, "drop_copies": 2, "packing": 2, "sharding": 2, "mask": 2, "mixing": 2, "drawn": 2}
    assert len(rows(f(none))) == kept.get(name, 0)


def test_one_class_of_labels(spark):
    d = docs(spark, [(1, prose(1, 30)), (2, prose(2, 30))])
    for labels, p in (([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([], 1.0)):
        found = op1_quality.quality_rules(d, spark.createDataFrame(labels, LABELS)).collect()
        assert [r["p_quality"] for r in found] == [p, p]
        assert {r["verdict"] for r in found} == {"keep" if p else "reject"}
