"""Rank sums, numbering, drawn sets and distances against brute force, with nulls, ties, single rows and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidia.operators import distances, numbering, responses, sampling, significance

OBS = "obs_id long, population string, match_group string, drug string, dose double, is_control boolean"
VALUES = "obs_id long, feature_id int, value double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def screen(seed, n=260, n_features=9, continuous=False):
    """Observations of two populations, three groups (one null), three drugs (one without a dose), and sparse values."""
    rng, obs, values = random.Random(seed), [], []
    for i in range(n):
        control = i % 3 == 0
        drug = None if control else rng.choice(["a", "b", "c"])
        obs.append((i, rng.choice(["p", "q"]), rng.choice(["g", "h", None]), drug or "DMSO", 0.0 if control else None if drug == "c" else rng.choice([0.1, 1.0]), control))
        for f in range(n_features - 1):
            if rng.random() < 0.5 and not (f == 2 and not control):  # a treatment loses feature 2 entirely
                v = rng.random() * 4 if continuous else float(rng.randint(1, 4))
                values.append((i, f, v + (3 if drug == "a" and f == 1 else 0)))
    values += [(0, 0, None), (1, 0, float("nan")), (2, 1, -1.0), (5000, 1, 2.0)]
    return obs, values


def counted_pairs(obs, values, keys, matched, features):
    """(keys, feature) -> z, p over dense vectors, by counting every pair of observations."""
    at = {(i, f): v for i, f, v in values if v is not None and not math.isnan(v) and v > 0}
    index = {"population": 1, "drug": 3, "dose": 4}
    treated = {}
    for o in obs:
        if not o[5]:
            treated.setdefault(tuple(o[index[k]] for k in keys), []).append(o)
    out = {}
    for key, mine in treated.items():
        groups = {o[2] for o in mine}
        control = [o for o in obs if o[5] and o[1] == key[0] and (not matched or o[2] in groups)]
        for f in features:
            x, y = [at.get((o[0], f), 0.0) for o in mine], [at.get((o[0], f), 0.0) for o in control]
            u = sum((b < a) + (b == a) / 2 for a in x for b in y)
            z = (u - len(x) * len(y) / 2) / math.sqrt(len(x) * len(y) * (len(x) + len(y) + 1) / 12)
            out[key, f] = z, math.erfc(abs(z) / math.sqrt(2)), any(x) or any(y)
    return out


def adjusted(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    q, least = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        q[order[rank - 1]] = least
    return q


@pytest.mark.parametrize("keys", [["population", "drug", "dose"], ["population", "drug"]])
@pytest.mark.parametrize("matched", [False, True])
@pytest.mark.parametrize("continuous", [False, True])
def test_wilcoxon_equals_all_pairs(spark, keys, matched, continuous):
    obs, values = screen(3, continuous=continuous)
    vocabulary = list(range(9))  # feature 8 has no value anywhere
    want = counted_pairs(obs, values, keys, matched, vocabulary)
    df = spark.createDataFrame(obs, OBS).repartition(3)
    got = significance.wilcoxon_deg(df, spark.createDataFrame(values, VALUES), 0.2, keys, matched, spark.createDataFrame([(f,) for f in vocabulary], "feature_id int")).collect()
    found = {(tuple(r[k] for k in keys), r.feature_id): r for r in got}
    assert set(found) == {k for k, v in want.items() if v[2]}
    q = {}
    for key in {k for k, _ in want}:
        q |= {(key, f): x for f, x in zip(vocabulary, adjusted([want[key, f][1] for f in vocabulary]))}
    for k, r in found.items():
        assert abs(r.z - want[k][0]) < 1e-9 and abs(r.p - want[k][1]) < 1e-6 and abs(r.q - q[k]) < 1e-5
        assert r.significant == (r.q < 0.2)
    # the feature that treatment loses has a row and a z
    assert any(f == 2 and r.z < -1 for (_, f), r in found.items())


def test_wilcoxon_without_controls_and_empty(spark):
    obs = spark.createDataFrame([(1, "p", "g", "a", 1.0, False), (2, "p", "h", "x", 0.0, True)], OBS)
    values = spark.createDataFrame([(1, 0, 2.0)], VALUES)
    only = significance.wilcoxon_deg(obs, values).collect()
    assert [(r.feature_id, r.z, r.p, r.q, r.significant) for r in only] == [(0, None, None, 1.0, False)]
    assert significance.wilcoxon_deg(obs.limit(0), values.limit(0)).count() == 0
    with pytest.raises(ValueError):
        significance.wilcoxon_deg(obs, values, 0.0)


def test_normal_tail(spark):
    zs = [0.0, 0.5, -1.96, 3.0, -6.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").orderBy("i").select(significance.two_sided("z").alias("p")).collect()]
    assert all(abs(p / math.erfc(abs(z) / math.sqrt(2)) - 1) < 2e-7 for z, p in zip(zs, got))


def test_planted_block_is_significant(spark):
    """Each drug shifts its own block of features, which the test finds, and hardly any other."""
    rng, obs, values = np.random.default_rng(1), [], []
    base = np.linspace(2, 18, 16)
    for i in range(300):
        drug = i % 5  # 0: control
        mean = base.copy()
        if drug:
            mean[(drug - 1) * 4 : drug * 4] += 2 + drug
        obs.append((i, "p", "g", "DMSO" if not drug else f"d{drug}", 0.0 if not drug else 1.0, not drug))
        values += [(i, f, float(v) + 1) for f, v in enumerate(rng.poisson(mean))]
    found = significance.wilcoxon_deg(spark.createDataFrame(obs, OBS), spark.createDataFrame(values, VALUES), 0.01).where("significant").collect()
    hits = {(int(r.drug[1]), r.feature_id) for r in found}
    block = {(d, f) for d in range(1, 5) for f in range((d - 1) * 4, d * 4)}
    assert block <= hits and len(hits - block) <= 2


def test_numbering_equals_sorted_order(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), i, rng.choice([None, 0, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v int, i long, w long").repartition(5)
    got = numbering.numbered(df, ["k"], ["v", "i"], "place", "n")
    assert got.columns == ["k", "v", "i", "w", "place", "n"]
    for key in ("a", "b", None):
        mine = sorted((v, i, w) for k, v, i, w in data if k == key)[:]
        assert sorted((r.place, r.v, r.i) for r in got.collect() if r.k == key) == [(p, v, i) for p, (v, i, _) in enumerate(sorted(mine, key=lambda r: r[:2]))]
        assert {r.n for r in got.collect() if r.k == key} == {len(mine)}
    sums = {r.i: r.place for r in numbering.numbered(df, [], ["v", "i"], "place", weight="w").collect()}
    total = 0
    for _, v, i, w in sorted(data, key=lambda r: (r[1], r[2])):
        assert sums[i] == total
        total += w or 0
    assert numbering.numbered(df.limit(0), ["k"], ["v"], "place").count() == 0
    ties = numbering.numbered(spark.range(90).select(F.lit("x").alias("k"), F.lit(1).alias("v")), ["k"], ["v"], "place")
    assert sorted(r.place for r in ties.collect()) == list(range(90))


def test_no_window_over_a_whole_population(spark):
    obs = spark.createDataFrame(screen(1)[0], OBS)
    plan = sampling.row_numbers(obs)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line and "row_number" in line]
    assert windows and all("_range" in line for line in windows)


def drawn(salt, *seed):
    return int(hashlib.sha256(":".join([salt, *map(str, seed)]).encode()).hexdigest()[:12], 16)


def test_sets_with_controls_equal_brute_force(spark):
    obs, _ = screen(6, 120)
    obs = [o for o in obs if o[4] is not None] + [(900, "lonely", "z", "a", 1.0, False)]
    got = sampling.condition_sets(spark.createDataFrame(obs, OBS).repartition(4), 6, "9").collect()
    by_condition = {}
    for o in obs:
        if not o[5]:
            by_condition.setdefault((o[1], o[3], o[4]), []).append(o)
    want = []
    for key, mine in by_condition.items():
        mine = sorted(mine, key=lambda o: hashlib.sha256(f"9:{o[0]}".encode()).hexdigest())
        for slot in range(6):
            o = mine[slot if len(mine) >= 6 else drawn("9", *key, slot) % len(mine)]
            controls = sorted(c[0] for c in obs if c[5] and c[1] == o[1] and c[2] == o[2])
            want.append((*key, slot, o[0], controls[drawn("9:control", *key, slot) % len(controls)] if controls else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r.control_id is None for r in got) and any(len(m) < 6 for m in by_condition.values()) and any(len(m) > 6 for m in by_condition.values())
    pooled = sampling.evaluation_sets(spark.createDataFrame(obs, OBS), 5, "1").collect()
    dose = {o[0]: o[4] for o in obs}
    heads = {(r.population, r.drug): dose[r.obs_id] for r in pooled if r.slot == 0}
    assert all(r.set_dose == heads[r.population, r.drug] and r.set_dose in r.doses for r in pooled) and len(pooled) == 5 * len(heads)
    assert sampling.condition_sets(spark.createDataFrame([], OBS), 3, "x").count() == 0


def test_dense_vectors_keep_empty_observations(spark):
    values = spark.createDataFrame([(1, 5, 2.0), (2, 6, 1.0), (3, 5, None)], VALUES)
    selected = spark.createDataFrame([(5, 0), (7, 1)], "feature_id int, place int")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "obs_id long")
    assert rows(sampling.dense_vector(values, selected, ids)) == [(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0])]
    assert len(rows(sampling.dense_vector(values, selected))) == 3


def test_missing_controls_are_found(spark):
    obs = spark.createDataFrame([(1, "p", "g", "a", 1.0, False), (2, "p", "g", "x", 0.0, True), (3, "p", "h", "a", 1.0, False), (4, "q", "h", "x", 0.0, True), (5, "q", "g", "b", 1.0, False)], OBS)
    assert rows(responses.missing_controls(obs)) == [("p", "h"), ("q", "g")]


PREDICTED = "population string, drug string, dose double, feature_id int, predicted double, observed double, control double"


def transport(p, o):
    """The definition, for one group."""
    lo, hi = min(*p, *o), max(*p, *o)
    if hi - lo < 1e-12:
        return 0.0
    edges = np.linspace(lo, hi, 65)
    a, b = (np.histogram(v, bins=edges)[0] / len(v) for v in (p, o))
    mid = (edges[1:] + edges[:-1]) / 2
    cost = (mid[:, None] - mid) ** 2
    kernel = np.exp(-cost / max(0.05 * np.median(cost[cost > 0]), 1e-8))
    u = v = np.ones(64)
    for _ in range(60):
        u = a / np.maximum(kernel @ v, 1e-30)
        v = b / np.maximum(kernel.T @ u, 1e-30)
    return math.sqrt((u[:, None] * kernel * v * cost).sum())


def discrepancy(p, o, most=512):
    def few(v):
        v = np.sort(v)
        return v if len(v) <= most else v[np.linspace(0, len(v) - 1, most).astype(int)]

    p, o = few(np.array(p)), few(np.array(o))
    both = np.concatenate([p, o])
    d = np.abs(both[:, None] - both)
    if not (d > 0).any():
        return 0.0
    s = 2 * max(np.median(d[d > 0]), 1e-8) ** 2
    k = lambda a, b: np.exp(-((a[:, None] - b) ** 2) / s).mean()
    return math.sqrt(max(k(p, p) + k(o, o) - 2 * k(p, o), 0))


def test_distances_equal_their_definition(spark):
    rng = np.random.default_rng(4)
    groups = {"plain": (rng.normal(size=40), rng.normal(1, 2, 40)), "ties": (rng.integers(0, 3, 30) * 1.0, rng.integers(0, 3, 30) * 1.0), "one": (np.array([1.0]), np.array([2.5])), "equal": (np.full(5, 2.0), np.full(5, 2.0)), "tiny": (np.arange(5) * 1e-6, np.arange(5) * 2e-6), "large": (rng.normal(size=1300), rng.normal(size=1300))}
    data = [("p", name, 1.0, i, float(x), float(y), 0.0) for name, (p, o) in groups.items() for i, (x, y) in enumerate(zip(p, o))]
    data += [("p", "null", 1.0, 0, None, 1.0, 0.0), ("p", "null", 1.0, 1, 2.0, 1.0, 0.0), ("p", "nan", None, 0, float("nan"), 1.0, 0.0), ("p", "inf", 1.0, 0, 1.0, float("inf"), 0.0)]
    df = spark.createDataFrame(data, PREDICTED).repartition(3)
    for f, truth in ((distances.sinkhorn, transport), (distances.mmd_rbf, discrepancy)):
        got = {r.drug: r[3] for r in f(df).collect()}
        assert got.keys() == groups.keys() | {"null", "nan", "inf"} and got["null"] is got["nan"] is got["inf"] is None
        for name, (p, o) in groups.items():
            assert abs(got[name] - truth(p, o)) < 1e-9, (f.__name__, name)
        assert f(df.limit(0)).count() == 0
