"""SimHash pairs and groups against all pairs."""

import random

import numpy as np
import pytest

from clausewright.llm import op6_neardup as n
from clausewright.llm import textvec

from .shared import docs, prose, rows


def _variants(seed: int, copies: int, changes: int) -> list[str]:
    rng = random.Random(seed)
    base = prose(seed, 300).split()
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = prose(rng.random(), 1)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    texts = [t for k in range(25) for t in _variants(k, 8, 24)] + [prose(1000 + k, 100) for k in range(100)] + [prose(1000, 100)] * 30
    return list(enumerate(texts))


def _all_pairs(fp: np.ndarray, ids: list[int]) -> set[tuple[int, int]]:
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=-1)
    i, j = np.nonzero(np.triu(d <= n.RADIUS, 1))
    return {(ids[a], ids[b]) for a, b in zip(i, j, strict=True)}


def test_pairs_recall_and_precision(spark, corpus):
    fp = textvec.simhash([t for _, t in corpus], (1, 2), 128)
    first = {tuple(f): i for i, f in reversed([(i, f) for i, f in enumerate(fp.tolist())])}
    ids = sorted(first.values())
    truth = _all_pairs(fp[ids], ids)
    nodes = spark.createDataFrame([(i, *fp[i].view(np.int64).tolist()) for i in ids], "id long, f0 long, f1 long")
    found = [(r["a"], r["b"]) for r in n.near_pairs(nodes).collect()]
    assert len(found) == len(set(found))
    assert set(found) <= truth
    assert len(found) >= 0.9 * len(truth) > 50


def test_recall_at_every_distance():
    rng = np.random.default_rng(1)
    for distance in (1, 4, 8, n.RADIUS):
        fp = rng.integers(0, 2, (400, 128), np.uint8)
        other = fp.copy()
        for row in other:
            row[rng.choice(128, distance, replace=False)] ^= 1
        x = (np.packbits(fp, axis=1, bitorder="little") ^ np.packbits(other, axis=1, bitorder="little")).view(np.uint64)
        met = ((x[:, None, :] & n.MASKS[None]) == 0).all(axis=2).any(axis=1)
        assert met.mean() >= 0.9


def test_pivot_filter_loses_nothing():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2, 128, np.uint8)
    points = np.array([centre ^ (rng.random(128) < 0.06) for _ in range(300)], np.uint8)
    fp = np.packbits(points, axis=1, bitorder="little").view(np.uint64)
    found = {(min(a, b), max(a, b)) for i, j, _ in n.bucket_pairs(fp, n.pivot_table(fp, n.pivots())) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == _all_pairs(fp, list(range(300)))


def test_groups_are_components(spark, corpus):
    found = {r["doc_id"]: r for r in n.groups(docs(spark, corpus)).collect()}
    assert len(found) == len(corpus)
    fp = textvec.simhash([t for _, t in corpus], (1, 2), 128)
    parent = list(range(len(corpus)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(_all_pairs(fp, list(range(len(corpus))))):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    agree = np.mean([found[i]["group_id"] == root(i) for i in found])
    assert agree > 0.98
    assert all(r["keep"] == (r["doc_id"] == r["group_id"]) for r in found.values())
    assert all(found[i]["group_id"] == 200 for i in range(300, 330))  # exact copies


def test_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r["label"] for r in n.components(edges).collect()} == {0, 100}


def test_drop_copies_keeps_one_of_each(spark):
    d = docs(spark, [(3, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (2, prose(2, 50)), (None, prose(1, 50)), (None, prose(1, 50)), (7, ""), (8, None)])
    kept = rows(n.drop_copies(d).select("doc_id"))
    assert sorted(kept, key=repr) == sorted([(1,), (2,), (None,), (None,), (7,), (8,)], key=repr)


def test_recall_against_text_similarity(spark):
    """One copy of each text, with 4 to 10 words replaced: pairs of like texts, by their words and word pairs, are in one group."""
    texts = []
    for k in range(120):
        words = prose(5000 + k, 230).split()
        copy, rng = list(words), random.Random(k)
        for at in rng.sample(range(230), rng.randint(4, 10)):
            copy[at] = prose(rng.random(), 1)
        texts += [" ".join(words), " ".join(copy)]
    features = [{*w, *zip(w, w[1:], strict=False)} for w in (t.split() for t in texts)]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(features[i] & features[j]) >= 0.85 * len(features[i] | features[j])]
    group = {r["doc_id"]: r["group_id"] for r in n.groups(docs(spark, list(enumerate(texts)))).collect()}
    assert len(alike) > 100
    assert sum(group[i] == group[j] for i, j in alike) >= 0.9 * len(alike)
    assert all(i // 2 == group[i] // 2 for i in group)


def _planted(count: int, distance: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` random fingerprints, and for each another one at the distance."""
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2, (count, 128), np.uint8)
    other = fp.copy()
    for row in other:
        row[rng.choice(128, distance, replace=False)] ^= 1
    return tuple(np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (fp, other))


def test_no_pair_within_the_radius_is_lost(spark):
    """Some of the rows at the very radius: a table of sampled bits would miss a tenth of them. The buckets are large enough to be grouped."""
    sides = [_planted(1500, d, d) for d in (n.RADIUS, n.RADIUS - 1, n.RADIUS + 1)]
    fp = np.concatenate([x for pair in sides for x in pair])
    nodes = spark.createDataFrame([(i, *f) for i, f in enumerate(fp.view(np.int64).tolist())], "id long, f0 long, f1 long")
    found = [(r["a"], r["b"], r["distance"]) for r in n.near_pairs(nodes).collect()]
    assert sorted(found) == [(i, i + 1500, n.RADIUS) for i in range(1500)] + [(i, i + 1500, n.RADIUS - 1) for i in range(3000, 4500)]


def test_part_pairs_in_every_part():
    """Rows of one bucket whose chunk differs in at most two bits: all of them, in groups by 0 to 13 bits."""
    rng = np.random.default_rng(5)
    for part, (a, b) in enumerate(n.PART_BITS):
        rows = (20, 60, 700)[part % 3]
        centre = rng.integers(0, 2, (rows // 4, 128), np.uint8)
        centre[:, a:b] = 1
        flips = (rng.random((4, *centre.shape)) < 0.06).astype(np.uint8)
        flips[:, :, a:b] = 0
        fp = np.unique(np.packbits((centre ^ flips).reshape(-1, 128), axis=1, bitorder="little").view(np.uint64), axis=0)
        truth = _all_pairs(fp, list(range(len(fp))))
        chunk = n.CHUNK_MASKS[part // 3]
        due = {(i, j) for i, j in truth if np.bitwise_count((fp[i] ^ fp[j]) & chunk).sum() <= n.SPARE}
        found = [(min(i, j), max(i, j)) for x, y, _ in n.part_pairs(fp, part) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(found) == len(set(found))
        assert due <= set(found) <= truth
        assert len(due) > 5


def test_trees_connect_what_the_edges_do():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, (2, 300)) * 7
    root = {int(x): int(x) for x in np.concatenate((a, b))}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[max(top(x), top(y))] = min(top(x), top(y))
    assert sorted(zip(*(x.tolist() for x in n.trees(a, b)), strict=True)) == sorted((top(x), x) for x in root if top(x) != x)


def test_dense_copies_give_few_links(spark):
    """A text's 300 different copies are 44,850 pairs; what is written of them is some edges an id."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2, 128, np.uint8)
    fp = np.unique(np.packbits([centre ^ (rng.random(128) < 0.05) for _ in range(300)], axis=1, bitorder="little").view(np.uint64), axis=0)
    nodes = spark.createDataFrame([(i, *f) for i, f in enumerate(fp.view(np.int64).tolist())], "id long, f0 long, f1 long")
    links = n.near_links(nodes)
    assert links.count() < len(n.PART_BITS) * len(fp)
    assert {r["label"] for r in n.components(links).collect()} == {0}
