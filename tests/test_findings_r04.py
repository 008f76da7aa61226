"""Findings of round 4: every pair of ids of similar sets."""

import os
import random

import pyarrow as pa
import pytest

from obsidia.operators import graph
from obsidia.sources import driver_tables as dt

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
near = lambda s, t: len(s & t) / len(s | t)


@pytest.mark.parametrize("block, chunk", [(3, 2), (8192, 64)])
@pytest.mark.parametrize("threshold, tokens", [(0.0, 6), (0.5, 6), (0.8, 40)])
def test_every_pair_of_ids_is_given(spark, monkeypatch, threshold, tokens, block, chunk):
    """of equal sets only the least id met other sets, and its copies met nothing but it."""
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(tokens)
    kinds = [frozenset(rng.sample(range(tokens), rng.randint(1, 6))) for _ in range(25)] + [frozenset(range(tokens)), frozenset(range(1, tokens))]
    sets = {f"id{i}": rng.choice(kinds) for i in range(70)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] + [("id0", None), (None, 1)], "id string, token int")
    want = {(a, b): near(s, t) for a, s in sets.items() for b, t in sets.items() if a < b and near(s, t) > threshold}
    assert any(sets[a] != sets[b] for a, b in want) and any(sets[a] == sets[b] for a, b in want)
    found = graph.jaccard_pairs(rows, threshold, copies=True).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.jaccard for r in found} == want
    both = graph.jaccard_pairs(rows, threshold, both_ways=True, copies=True, digits=2).collect()
    assert len(both) == 2 * len(want)
    assert {(r.a, r.b): r.jaccard for r in both} == {k: pytest.approx(v, abs=0.005 + 1e-9) for p, v in want.items() for k in (p, p[::-1])}


@given
def test_baskets_of_all_customers(spark):
    """F5, on the given tables."""
    from obsidia.queries_inputs import tanimoto_pairs

    orders = {r.o_orderkey: r.o_custkey for r in dt.load(spark, DATA, "orders").collect()}
    sets = {}
    for r in dt.counts(spark, DATA).collect():
        sets.setdefault(orders[r.obs_id], set()).add(r.feature_id)
    want = {(a, b): round(near(s, t), 6) for a, s in sets.items() for b, t in sets.items() if a != b and near(s, t) > 0.8}
    found = tanimoto_pairs(spark, DATA).collect()
    assert len(found) == len(want) and {(r.src, r.dst): round(r.similarity, 6) for r in found} == want
    assert len({frozenset(s) for s in sets.values()}) < len(sets)


@pytest.mark.parametrize("heads, cut", [(0, 0), (2, 0), (0, 11), (2, 11)])
def test_blocks_are_compared_in_parts(monkeypatch, heads, cut):
    """parts of two blocks smaller than the blocks; with heads a pair is left to the first token that both have there."""
    for name, value in (("STRIP", 4), ("SPAN", 5), ("WIDTH", 3), ("BATCH", 6)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(heads + cut)
    sets = [sorted({0} | set(rng.sample(range(1, 9), rng.randint(2, 7)))) for _ in range(30)]
    ids = [[10 * i + x for x in range(1 + i % 3)] for i in range(30)]
    batch = lambda lo, hi: pa.record_batch(
        [pa.array(ids[lo:hi]), pa.array([len(s) for s in sets[lo:hi]], pa.int32()), pa.array(sets[lo:hi]), pa.array([min(heads, len(s) - 1) for s in sets[lo:hi]], pa.int32())]
        + [pa.array([x] * (hi - lo), pa.int32()) for x in (int(bool(cut) and lo >= cut), 0, int(bool(cut)))], names=["ids", "n", "s", "at", "block", "lo", "hi"])
    found = []
    for b in graph._compare(iter([batch(0, 11), batch(11, 30)]), 0.5, None):
        for xs, ys, js in zip(*(b.column(c).to_pylist() for c in ("xs", "ys", "js"))):
            assert len(ys) == len(js)
            found += [(min(x, y), max(x, y), j) for x in xs for y, j in zip(ys, js)]
    earlier = lambda s, t: set(s[:heads]) & set(t[:heads])
    pairs = [(i, j) for i in range(30) for j in range(i) if (not cut or j < cut <= i) and near(set(sets[i]), set(sets[j])) > 0.5 and not earlier(sets[i], sets[j])]
    want = [(min(x, y), max(x, y), near(set(sets[i]), set(sets[j]))) for i, j in pairs for x in ids[i] for y in ids[j]]
    assert sorted(found) == sorted(want) and (heads or want)
