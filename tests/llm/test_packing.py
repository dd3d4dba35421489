"""Packing, sharding and mixing against plain greedy versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import op7_packing, op8_sharding, op10_mixing
from clausewright.llm.balanced import Successors

from .shared import docs, prose, rows, with_extra


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 4999)), max_size=200))
def test_successors(steps):
    tree, plain = Successors(5000), set()
    for add, x in steps:
        (tree.add if add else tree.discard)(x)
        (plain.add if add else plain.discard)(x)
        assert tree.successor(x) == min((y for y in plain if y >= x), default=-1)
    assert tree.successor(5000) == -1


def _plain_best_fit(items, capacity, limits):
    bins = []  # [room, clusters, sources, when its room last changed]
    out = []
    for clock, (size, cluster, source) in enumerate(items):
        fits = [b for b in bins if b[0] >= size and (cluster < 0 or cluster not in b[1]) and b[2][source] < limits[source]]
        if not fits:
            bins.append([capacity, set(), Counter(), 0])
        b = min(fits, key=lambda b: (b[0], b[3])) if fits else bins[-1]
        out.append((bins.index(b), capacity - b[0]))
        b[0] -= size
        b[1].add(cluster)
        b[2][source] += 1
        b[3] = clock
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 5), st.integers(0, 2)), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=3, max_size=3), st.sampled_from([0.01, 0.3, 1.1]))
def test_best_fit_against_plain(items, limits, hot):
    items.sort(key=lambda x: -x[0])
    bins, offsets = op7_packing.best_fit(*map(list, zip(*items, strict=True)), 20, limits, hot)
    assert list(zip(bins, offsets, strict=True)) == _plain_best_fit(items, 20, limits)


@pytest.mark.parametrize("source", [lambda i: "only", lambda i: "big" if i % 3 else f"s{i}"])
def test_hot_source_fills_its_bins(spark, source):
    data = [(i, prose(i, 5 + i % 7), source(i)) for i in range(1500)]
    found = op7_packing.pack(docs(spark, data), capacity=512).collect()
    assert sum(r["words"] for r in found) / (512 * len({r["bin_id"] for r in found})) > 0.9


def test_one_source_takes_linear_time():
    def visited(n):
        calls = 0
        find = op7_packing.Bins.find

        def counted(self, size, fits):
            def count(b):
                nonlocal calls
                calls += 1
                return fits(b)

            return find(self, size, count)

        with pytest.MonkeyPatch.context() as m:
            m.setattr(op7_packing.Bins, "find", counted)
            op7_packing.best_fit([7] * n, [0] * (n // 3) + [-1] * (n - n // 3), [0] * n, 100, [2])
        return calls

    assert visited(2000) <= 2.2 * visited(1000)


def test_null_and_heavy_ids_are_spread(spark):
    data = [(None, prose(i, 20)) for i in range(300)] + [(7, prose(1000 + i, 20)) for i in range(300)] + [(1000 + i, prose(2000 + i, 20)) for i in range(100)]
    found = op7_packing.pack(docs(spark, data), capacity=100, shard_pieces=100).collect()
    assert len(found) == 700
    assert max(Counter(r["bin_id"] >> 32 for r in found).values()) < 160


def test_pack_covers_every_word_and_keeps_constraints(spark):
    rng = random.Random(1)
    data = [(i, prose(i % 40, rng.randint(1, 150) if i >= 40 else 60), f"s{i % 3}") for i in range(120)] + [(500, prose(9, 1000)), (501, None), (502, " ")]
    text = {i: t for i, t, *_ in data}
    source = {r[0]: r[2] if len(r) > 2 else "web" for r in data}
    found = op7_packing.pack(docs(spark, data), capacity=128, per_source=2, shard_pieces=40).collect()
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append(r)
    for i, t in text.items():
        assert sum(r["words"] for r in got[i]) == len((t or "").split())
        assert sorted(r["first_word"] for r in got[i]) == [128 * k for k in range(max(1, math.ceil(len((t or "").split()) / 128)))]
    bins = defaultdict(list)
    for r in found:
        if r["words"]:
            bins[r["bin_id"]].append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r["bin_offset"])
        assert all(a["bin_offset"] + a["words"] <= b["bin_offset"] for a, b in zip(rs, rs[1:], strict=False)) and rs[-1]["bin_offset"] + rs[-1]["words"] <= 128
        assert max(Counter(source[r["doc_id"]] for r in rs).values()) <= 2
        assert max(Counter(text[r["doc_id"]].lower() for r in rs).values()) == 1


def _plain_bfd(sizes, capacity):
    shards = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(shards) if room >= s]
        if s > capacity:
            shards.append(0)
        elif s == 0:
            continue
        elif fits:
            shards[min(fits, key=lambda k: (shards[k], k))] -= s
        else:
            shards.append(capacity - s)
    return shards


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_shard_plan_equals_plain_bfd(sizes):
    counts = Counter(sizes)
    used = Counter()
    for size, first, each, shard, oversize in op8_sharding.plan(dict(counts), 50):
        later = [f for s, f, *_ in op8_sharding.plan(dict(counts), 50) if s == size and f > first]
        for rank in range(first, min(later, default=counts[size])):
            used[shard + (rank - first) // each] += size
            assert oversize == (size > 50)
    rooms = sorted(50 - used[k] if used[k] <= 50 else 0 for k in used)
    assert rooms == sorted(_plain_bfd(sizes, 50))


def test_shard(spark):
    data = [(i, prose(i % 20, 5 + i % 20)) for i in range(60)] + [(100, "x" * 5000), (101, None), (102, ""), (None, prose(1, 6))]
    found = op8_sharding.shard(docs(spark, data), capacity=1024, unit=16).collect()
    assert len(found) == len(data)
    groups = defaultdict(set)
    load = {}
    for r in found:
        groups[r["group_id"]].add(r["shard_id"])
        load[r["group_id"]] = (r["shard_id"], r["group_bytes"], r["oversize"])
    assert all(len(s) == 1 for s in groups.values())
    total = Counter()
    for s, b, over in load.values():
        assert over == (b > 1024)
        if not over:
            total[s] += b
    assert max(total.values()) <= 1024


def test_weights_meet_entropy_and_repetition():
    words = {"a": 1_000_000, "b": 50_000, "c": 2_000, None: 500, "none": 0}
    alpha, w = op10_mixing.weights(words, sum(words.values()), 0.9, 1e9)
    spread = -sum(x * math.log(x) for x in w.values() if x)
    assert 0 <= alpha < 1 and spread == pytest.approx(0.9 * math.log(4), abs=1e-6)
    _, w = op10_mixing.weights(words, sum(words.values()), 0.97, 4.0)
    assert max(sum(words.values()) * w[s] / n for s, n in words.items() if n) <= 4.0 + 1e-6
    assert sum(w.values()) == pytest.approx(1)
    assert op10_mixing.weights({"a": 5}, 5)[1] == {"a": 1.0}
    q = op10_mixing.quotas(words, w, 12_345)
    assert sum(q.values()) == 12_345 and q["none"] == 0


def test_mix_meets_budget(spark):
    data = [(i, prose(i, 40), "big") for i in range(300)] + [(1000 + i, prose(i, 30), "small") for i in range(20)] + [(2000, None, "blank")]
    n = {"big": 12_000, "small": 600, "blank": 0}
    quota = op10_mixing.quotas(n, op10_mixing.weights(n, 12_600)[1], 12_600)
    found = op10_mixing.mix(docs(spark, data), block_words=500).collect()
    size = {i: len((t or "").split()) for i, t, _ in data}
    got = Counter()
    for r in found:
        got[r["source"]] += size[r["doc_id"]]
    for s, most in quota.items():
        assert most - 80 <= got[s] <= most
    assert len([r for r in found if r["source"] == "blank"]) == 1
    passes = Counter((r["doc_id"], r["pass"]) for r in found)
    assert max(passes.values()) == 1
    half = [r for r in found if r["mix_rank"] < 0.5]
    assert abs(sum(size[r["doc_id"]] for r in half) / sum(got.values()) - 0.5) < 0.1
    assert all(0 <= r["mix_rank"] < 1 for r in found)


def _hashes(spark, values, *lead):
    """op10's hash of each tuple of columns, from Spark."""
    from pyspark.sql import functions as F

    kinds = {str: "string", int: "long", type(None): "string"}
    schema = ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values[0]))
    df = spark.createDataFrame(values, schema)
    return [r[0] for r in df.select(op10_mixing._hash(*[F.lit(x) for x in lead], *[F.col(c) for c in df.columns])).collect()]


@pytest.mark.parametrize("span", [3, 10_000])
def test_draw_against_plain(spark, monkeypatch, span):
    monkeypatch.setattr(op10_mixing.prefix_sums, "__defaults__", (span,))
    rng = random.Random(3)
    data = [(i, prose(i, rng.randint(1, 40)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(400)] + [(900, "", "a"), (901, None, "b")]
    size = {i: len((t or "").split()) for i, t, _ in data}
    total = Counter()
    for i, _, s in data:
        total[s] += size[i]
    total = dict(total)
    budget, per_block = sum(total.values()) * 3 // 2, 100
    quota = op10_mixing.quotas(total, op10_mixing.weights(total, budget)[1], budget)
    place = dict(zip([i for i, *_ in data], _hashes(spark, [(i, s) for i, _, s in data]), strict=True))
    torn = dict(zip([i for i, *_ in data], _hashes(spark, [(i,) for i, *_ in data], "torn"), strict=True))
    expected = Counter()
    for s, n in total.items():
        blocks, full = max(1, -(-n // per_block)), quota[s] // n
        of = defaultdict(list)
        for i, _, source in data:
            if source == s:
                of[place[i] % blocks].append(i)
        for turn in range(full):
            expected.update((i, turn) for ids in of.values() for i in ids)
        room = quota[s] - full * n
        order = _hashes(spark, [(s, full, b) for b in sorted(of)], "order")
        for _, b in sorted(((h % 2**64) >> 12, b) for h, b in zip(order, sorted(of), strict=True)):
            if room <= 0:
                break
            words = sum(size[i] for i in of[b])
            if words <= room:
                expected.update((i, full) for i in of[b])
            else:
                left = room
                for i in sorted(of[b], key=lambda i: (torn[i], i)):
                    left -= size[i]
                    if left < 0:
                        break
                    expected[i, full] += 1
            room -= words
    found = op10_mixing.mix(docs(spark, data), budget=budget, block_words=per_block).collect()
    assert Counter((r["doc_id"], r["pass"]) for r in found) == expected


def test_drawn_rows_keep_clashing_columns(spark):
    data = docs(spark, [(i, prose(i, 20), "s") for i in range(40)] + [(None, prose(50 + i, 20), "s") for i in range(40)])
    wide = with_extra(data)
    found = op10_mixing.drawn(wide, block_words=100)
    assert found.columns == wide.columns and found.count() == 80
    assert rows(found.select("doc_id", "text")) == rows(data.select("doc_id", "text"))
    assert len({r["block"] for r in op10_mixing.mix(data, block_words=100).where("doc_id IS NULL").collect()}) > 5


@pytest.mark.parametrize("span, hot", [(50_000, 10_000), (3, 2), (1, 10_000)])
def test_shard_against_plain(spark, monkeypatch, span, hot):
    monkeypatch.setattr(op8_sharding, "HOT_ROWS", hot)
    data = [(i, prose(i % 50, 3 + i % 9)) for i in range(160)] + [(500 + i, f"same size {i:02}") for i in range(40)] + [(900, "x" * 700), (901, None), (902, ""), (903, None)]
    size, text = Counter(), {}
    for _, t in data:
        g = "null" if t is None else hashlib.md5(t.encode()).hexdigest()
        size[g] += len((t or "").encode())
        text[g] = t
    rooms, expected = [], {}
    for g in sorted(size, key=lambda g: (-(-(-size[g] // 16)), g)):
        units = -(-size[g] // 16)
        fits = [k for k, room in enumerate(rooms) if room >= units]
        if units > 32:
            rooms.append(0)
            expected[g] = len(rooms) - 1
        elif not units:
            expected[g] = 0
        else:
            k = min(fits, key=lambda k: (rooms[k], k)) if fits else len(rooms)
            rooms += [] if fits else [32]
            rooms[k] -= units
            expected[g] = k
    found = op8_sharding.shard(docs(spark, data), capacity=512, span=span).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, *_ in data)
    assert {r["group_id"]: (r["group_bytes"], r["shard_id"]) for r in found} == {g: (size[g], expected[g]) for g in size}
