"""Errors, nulls, ties and empty tables of the core operators, and planted signals."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidia.functions import text as tx
from obsidia.operators import checks, cleaning, distances, features, graph, responses, sampling, splits, summaries
from obsidia.sources import sparse


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_functions(spark):
    df = spark.createDataFrame([(" a \t b ", "NaN", ["b ", "1-a"], 0.5), (None, " x ", None, None)], "s string, n string, c array<string>, d double")
    out = df.select(tx.squash(F.col("s")), tx.null_like(F.col("n")), tx.combination_key(F.col("c")), tx.log_dose("d"), tx.bucketize("d", [0.5, 1]), tx.normalise_name(F.concat(F.lit("É (b) "), "n"))).collect()
    assert tuple(out[0]) == ("a b", None, "1-a|b", math.log(0.5), 1, "enan") and out[1][:2] == (None, "x") and out[1][3] is None
    broken = spark.createDataFrame([("[('a', 'b')]",), ("",), (None,)], "t string").select(tx.parse_treatment(F.col("t")).alias("t")).collect()
    assert [r.t.drug for r in broken] == ["", "", ""]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "DMSO ", None, 1.0), (0, "x", "nan", 1.0), (None, "y", "C", float("nan")), (2, None, "C", 0.1)], "flag int, drug string, smiles string, dose double")
    flags = df.select(cleaning.control_flag(df, "flag", "drug").alias("is_control"), "smiles", "dose")
    assert [r.is_control for r in flags.collect()] == [True, False, False, True]
    assert [r.eligible for r in cleaning.eligibility(flags).collect()] == [True, False, False, True]
    obs = spark.createDataFrame([("a",), (None,)], "population string")
    assert cleaning.select_populations(obs, ["a"]).count() == 1
    for wanted in ([], ["b"]):
        with pytest.raises(ValueError):
            cleaning.select_populations(obs, wanted)
    tokens = spark.createDataFrame([(1, "s"), (2, None)], "token_id int, symbol string")
    vocabulary = spark.createDataFrame([(5, "s"), (7, "s"), (8, None), (9, "t")], "target_id int, symbol string")
    assert rows(cleaning.map_features(tokens, vocabulary)) == [(1, 7)] and rows(cleaning.unmapped_features(tokens, vocabulary)) == [("t",)]


def test_sources(spark, tmp_path):
    long = spark.createDataFrame([(1, 2, 1.0), (1, 0, 3.0), (2, 1, None), (3, 1, 1.0)], "obs_id long, feature_id int, value double")
    ids = spark.createDataFrame([(1,), (2,)], "obs_id long")
    assert rows(sparse.long_to_sparse(long, ids)) == [(1, [0, 2], [3.0, 1.0]), (2, [], [])]
    with pytest.raises(ValueError):
        sparse.long_to_sparse(long, spark.createDataFrame([(9,)], "obs_id long"))
    with pytest.raises(ValueError):
        sparse.expression_membership(ids, long)
    wide = spark.createDataFrame([(1, 0.0, float("nan"), 2.0)], "obs_id long, `a.b` double, c double, d double")
    assert rows(sparse.wide_to_sparse(wide, {"a.b": 4, "c": 1, "d": 0})) == [(1, [0], [2.0])]
    path = f"{tmp_path}/m.mtx"
    with open(path, "w") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n% made here\n2 3 3\n1 1 5\n2 3 3\n2 1 7\n")
    assert rows(sparse.read_matrix_market(spark, path, 3)) == [(0, [0, 1], [5.0, 7.0]), (2, [1], [3.0])]
    assert rows(sparse.read_matrix_market(spark, path, 2)) == [(0, [0], [5.0]), (1, [0, 2], [7.0, 3.0])]
    with pytest.raises(ValueError):
        sparse.read_matrix_market(spark, path, 4)
    long.write.parquet(f"{tmp_path}/t.parquet")
    assert sparse.read_table(spark, f"{tmp_path}/t.parquet", ["value"]).columns == ["value"]
    with pytest.raises(ValueError):
        sparse.read_table(spark, f"{tmp_path}/t.parquet", ["none"])


def test_sampling_and_summaries(spark):
    obs = spark.createDataFrame([("a", i) for i in range(3)], "population string, obs_id long")
    got = sampling.sample_sets(obs, ["population"], 7, "s").collect()
    # fewer rows than slots: drawn with replacement, by a hash of salt, key and slot
    order = sorted(range(3), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())
    want = [(s, order[int(hashlib.sha256(f"s:a:{s}".encode()).hexdigest()[:12], 16) % 3]) for s in range(7)]
    assert sorted((r.slot, r.obs_id) for r in got) == want
    assert len({r.obs_id for r in sampling.sample_sets(obs, ["population"], 2, "s").collect()}) == 2
    deg = spark.createDataFrame([("a", 1, -2.0, True), ("a", 2, 2.0, True), ("a", 3, 9.0, False), ("a", 4, None, True)], "population string, feature_id int, delta double, mask boolean")
    assert rows(sampling.top_features(deg, ["population"], 3)) == [("a", 1, 1), ("a", 2, 2)]
    assert abs(summaries.t_quantile(0.975, 1) - 12.7062047) < 1e-5 and abs(summaries.t_quantile(0.975, 4) - 2.77644511) < 1e-7 and abs(summaries.t_quantile(0.975, 9) - 2.26215716) < 1e-7
    runs = spark.createDataFrame([(1.0, float("nan")), (3.0, 2.0), (None, None)], "x double, y double")
    found = {r.metric: r for r in summaries.seed_summary(runs, ["x", "y"]).collect()}
    assert found["x"].n == 2 and abs(found["x"].ci95_half_width - 12.7062047 * math.sqrt(2) / math.sqrt(2)) < 1e-4
    assert found["y"].n == 1 and found["y"]["std"] is None and found["y"].lower is None


def test_checks(spark):
    bounds = spark.createDataFrame([("a", 1), ("b", 5), ("c", 99), ("d", None)], "population string, n_cells long")
    assert rows(checks.condition_bounds(bounds, 2, 10)) == [("a", 1, "few"), ("c", 99, "many"), ("d", None, "null")]
    parts = spark.createDataFrame([(1, "train"), (1, "external"), (2, "train"), (2, "train")], "obs_id long, part string")
    assert rows(splits.overlapping_rows(parts)) == [(1, 2)]


def test_adjusted_p(spark):
    df = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03), ("a", 4, None), ("b", 1, 0.2)], "k string, i int, p double")
    got = {(r.k, r.i): round(r.q, 6) for r in responses.benjamini_hochberg(df, ["k"]).collect()}
    assert got == {("a", 1): 0.04, ("a", 2): 0.053333, ("a", 3): 0.053333, ("a", 4): 1.0, ("b", 1): 0.2}


def test_trend_needs_features(spark):
    few = spark.createDataFrame([("a", i, 1.0 + i, 2.0 + i) for i in range(5)], "population string, feature_id int, mean double, variance double")
    with pytest.raises(Exception, match="too few features"):
        features.variance_trend(few, "population").collect()


def test_combination_split_errors(spark):
    obs = spark.createDataFrame([(i, f"p{i % 5}", f"d{i % 4}", 1.0, False) for i in range(200)], "obs_id long, population string, drug string, dose double, is_control boolean")
    with pytest.raises(ValueError):
        splits.split_combination(obs, 1)
    held = splits.split_combination(obs.where("population in ('p0', 'p1', 'p2')"), 1).where("part = 'external'").select("population", "drug").distinct().collect()
    assert len(held) == 3 == len({r.drug for r in held})


def test_planted_signal(spark):
    """Features of the drug's block are found, and no other, by Welch's t."""
    import numpy as np

    rng, cells, of = np.random.default_rng(5), [], []
    for i in range(240):
        drug = ("DMSO", "d0", "d1", "d2")[i % 4]
        level = np.linspace(2, 18, 12)
        if drug != "DMSO":
            k = int(drug[1])
            level[3 * k : 3 * k + 3] += 8
        of.append((i, "p", "g", drug, 0.0 if drug == "DMSO" else 1.0, drug == "DMSO"))
        cells += [(i, f, float(v)) for f, v in enumerate(rng.poisson(level)) if v]
    obs = spark.createDataFrame(of, "obs_id long, population string, match_group string, drug string, dose double, is_control boolean")
    top = responses.welch_top(obs, spark.createDataFrame(cells, "obs_id long, feature_id int, value double"), 3).collect()
    assert {(r.drug, r.feature_id) for r in top} == {(f"d{k}", 3 * k + j) for k in range(3) for j in range(3)}


def test_even_sample_and_bins(spark):
    df = spark.range(10).select(F.lit("p").alias("g"), F.col("id").alias("o")).unionByName(spark.createDataFrame([("q", 1), ("q", 2)], "g string, o long"))
    assert rows(sampling.even_sample(df, ["g"], "o", 4)) == [("p", 0), ("p", 3), ("p", 6), ("p", 9), ("q", 1), ("q", 2)]
    assert rows(sampling.even_sample(df.limit(0), ["g"], "o", 4)) == []
    values = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (None,), (5.0,)], "value double")
    assert rows(features.expression_bins(values, 5)) == [(0, 0.0), (1, 1.0), (2, 3.0), (3, 5.0)]
    assert rows(features.expression_bins(values.where("value = 0"), 5)) == []
    for bad in (lambda: sampling.even_sample(df, ["g"], "o", 1), lambda: features.expression_bins(values, 3)):
        with pytest.raises(ValueError):
            bad()


def test_abundance_sample(spark):
    conditions = spark.createDataFrame([("a", 1), ("b", 0), ("c", 9000), ("d", 999)], "drug string, n_cells int")
    drawn = sampling.abundance_sample(conditions, ["drug"], 3000, "1").groupBy("drug").count().collect()
    share = {r["drug"]: r["count"] / 3000 for r in drawn}
    assert sum(share.values()) == pytest.approx(1) and "b" not in share and share["c"] == pytest.approx(0.9, abs=0.03)
    assert sampling.abundance_sample(conditions, ["drug"], 0, "1").count() == 0
    with pytest.raises(ValueError):
        sampling.abundance_sample(conditions.where("n_cells = 0"), ["drug"], 5, "1")


def test_seen_components(spark):
    obs = spark.createDataFrame([(1, "p", ["a"]), (2, "p", ["a", "b"]), (3, "p", ["b", "c"]), (4, "q", ["a", "a"]), (5, "q", []), (6, "q", None), (7, "p", ["a"])], "obs_id long, population string, components array<string>")
    found = {r.obs_id: r.part for r in splits.split_seen_components(obs, 0).collect()}
    assert found == {1: "train", 7: "train", 2: "one_seen", 3: "both_unseen", 4: "both_seen"}
    assert sorted(r.part for r in splits.split_seen_components(obs, 0.5).where("obs_id in (1, 7)").collect()) == ["internal", "train"]
    with pytest.raises(ValueError):
        splits.split_seen_components(obs, 1)


def test_edges_of_graphs(spark):
    triples = spark.createDataFrame([("drug", "A-1", "gene/protein", "g"), ("Protein", "G", "DRUG", "a 1"), ("gene", "g", "gene", "g"), (None, "a1", "gene", "g"), ("drug", "zz", "gene", "g")], "x_type string, x_name string, y_type string, y_name string")
    drugs = spark.createDataFrame([("a1", 1), ("A 1", 2), (None, 3)], "name string, drug_id long")
    genes = spark.createDataFrame([("G", 5)], "name string, feature_id long")
    assert rows(graph.typed_edges(triples, drugs, genes)) == [(2, 5)]
    edges = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 0), (None, 1)], "src long, dst long")
    found = graph.negative_edges(edges, 4, "s", redraws=64).collect()
    assert len(found) == 3 and all(r.negative == 3 if r.src == 0 else r.negative in (2, 3) for r in found)
    full = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert rows(graph.negative_edges(full, 2, "s")) == [(0, 1, None), (1, 0, None)]
    chain = spark.createDataFrame([(2, 1, "k"), (3, 2, "k"), (4, 3, "k"), (5, 1, "j"), (6, 1, "k"), (7, 1, "k")], "src long, dst long, kind string")
    root = spark.createDataFrame([(1,)], "node long")
    near = graph.in_neighbours(chain, root, 9, 2, "s")
    assert rows(near.select("src", "dst")) == [(2, 1), (3, 2), (5, 1), (6, 1), (7, 1)]
    assert graph.in_neighbours(chain, root, 1, 1, "s").groupBy("kind").count().count() == 2


def test_first_components(spark):
    np = pytest.importorskip("numpy")
    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 1, 3, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    got = np.array([[r.pc1, r.pc2] for r in features.first_components(df).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    directions = np.linalg.svd(centred)[2][:2]
    directions *= np.sign(directions[np.arange(2), abs(directions).argmax(axis=1)])[:, None]
    assert np.allclose(got, centred @ directions.T, atol=1e-8)


def test_neighbours_similar_sets_and_holdouts(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1, 2.0), (2, 7.0), (3, 4.0)], "node long, value double")
    assert rows(graph.neighbor_mean(edges, nodes)) == [(1, 0.0), (2, 3.0), (3, 0.0)]
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "d"), (4, None)], "id long, token string")
    assert [(a, b) for a, b, _ in rows(graph.jaccard_pairs(sets, 0.5))] == [(1, 2)]
    assert rows(graph.jaccard_pairs(sets, 0.7)) == []
    assert [splits.holdout_count(x, 10) for x in (0.25, 0.01, 3)] == [2, 1, 3]
    with pytest.raises(ValueError):
        splits.holdout_count(0, 10)


def _conditions(spark, n=9, features=7, seed=1):
    rng = np.random.default_rng(seed)
    p, o, c = rng.normal(size=(3, n, features)).round(3)
    rows = [("abc"[i % 2], f"d{i // 2}", 1.0, f, float(p[i, f]), float(o[i, f]), float(c[i, f])) for i in range(n) for f in range(features)]
    return p, o, c, spark.createDataFrame(rows, "population string, drug string, dose double, feature_id int, predicted double, observed double, control double")


@pytest.mark.parametrize("distance", ["euclidean", "cityblock"])
def test_discrimination_by_blocks(spark, distance):
    p, o, _, rows = _conditions(spark)
    o[4] = o[2]  # a tie within population a
    rows = rows.join(spark.createDataFrame([(i // 2, "abc"[i % 2], f, float(o[i, f])) for i in range(9) for f in range(7)], "d int, population string, feature_id int, seen double")
                     .withColumn("drug", F.concat(F.lit("d"), "d")).drop("d"), ["population", "drug", "feature_id"]).withColumn("observed", F.col("seen")).drop("seen")
    want = {}
    for k, name in enumerate("ab"):
        mine = list(range(k, 9, 2))
        far = lambda i, j: (np.abs(p[i] - o[j]) if distance == "cityblock" else (p[i] - o[j]) ** 2).sum()
        want[name] = 1 - 2 * np.mean([sum(far(i, j) < far(i, i) - 1e-12 for j in mine) / len(mine) for i in mine])
    for block in (2, 128):
        got = {r.population: r.pds for r in responses.discrimination(rows, distance, block).collect()}
        assert got == pytest.approx(want)
    assert responses.discrimination(rows.where("false"), distance).count() == 0


def test_covariance_score_by_blocks(spark):
    p, o, c, rows = _conditions(spark, seed=2)
    cp, co = np.cov(p - c, rowvar=False), np.cov(o - c, rowvar=False)
    want = np.linalg.norm(cp - co) / np.linalg.norm(co)
    for block in (2, 128):
        assert distances.covariance_score(rows, block=block).first().css == pytest.approx(want, rel=1e-6)
    assert distances.covariance_score(rows.where("drug = 'd0' and population = 'a'")).first().css is None
    assert distances.covariance_score(rows.where("false")).first().css is None
