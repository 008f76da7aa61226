"""Metrics, summaries, prepared tables, splits and checks: definitions by numpy, nulls, ties, single rows and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidia.operators import census, cleaning, distances, evaluation, features, preparation, responses

ROWS = "population string, drug string, dose double, feature_id int, predicted double, observed double, control double"
OBS = "obs_id long, population string, match_group string, drug string, dose double, is_control boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def predicted(seed=1, n_features=12):
    rng, out = np.random.default_rng(seed), []
    for p in ("p", "q"):
        for d in ("a", "b", "c"):
            for dose in (0.1, 1.0):
                c = rng.normal(3, 1, n_features)
                o = c + rng.normal(0, 1, n_features)
                out += [(p, d, dose, f, float(o[f] + rng.normal(0, 0.3)), float(o[f]), float(c[f])) for f in range(n_features)]
    return out


def arrays(data):
    held = {}
    for p, d, dose, f, a, b, c in data:
        held.setdefault((p, d, dose), {})[f] = (a, b, c)
    return {k: np.array([v[f] for f in sorted(v)]).T for k, v in held.items()}


def score(p, o, metric):
    far = lambda a, b: np.abs(a - b).sum() if metric == "cityblock" else np.sqrt(((a - b) ** 2).sum())
    return 1 - 2 * np.mean([sum(far(x, y) < far(x, o[i]) for y in o) / len(o) for i, x in enumerate(p)])


def test_summary_equals_numpy(spark):
    data = predicted()
    held = arrays(data)
    df = spark.createDataFrame(data, ROWS).repartition(3)
    records = evaluation.all_metrics(df, marks=df.where("feature_id < 4"), top_k=3)
    got = evaluation.full_summary(df, records, evaluation.METRICS, top_k=5).first()
    keys = sorted(held)
    p, o, c = (np.array([held[k][i] for k in keys]) for i in range(3))
    assert got.n_conditions == 12 == got.n_few_marks and math.isclose(got.mse, ((p - o) ** 2).mean(), rel_tol=1e-9)
    pops = np.array([k[0] for k in keys])
    for name, metric in (("pds", "cityblock"), ("pds_euclidean", "euclidean")):
        assert math.isclose(got[name], np.mean([score(p[pops == g], o[pops == g], metric) for g in ("p", "q")]), abs_tol=1e-9)
        assert math.isclose(got[f"{name}_global"], score(p, o, metric), abs_tol=1e-9)
    d = p - c
    drugs, mean = np.array([k[1] for k in keys]), d.mean(axis=0)
    model = np.tile(mean, (12, 1))
    for label in (pops, drugs):
        for g in set(label):
            model[label == g] += d[label == g].mean(axis=0) - mean
    assert math.isclose(got.disentanglement, np.clip(1 - np.var(d - model) / np.var(d), 0, 1), abs_tol=1e-9)
    cov = lambda x: np.cov(x.T)
    assert math.isclose(got.css, np.linalg.norm(cov(d) - cov(o - c)) / np.linalg.norm(cov(o - c)), rel_tol=1e-6)
    by = [[(x[pops == g] - c[pops == g]).mean(axis=0) for x in (p, o)] for g in ("p", "q")]
    parts = [np.mean([np.corrcoef(*x)[0, 1] for x in by]), np.mean([np.mean(np.sign(a) == np.sign(b)) for a, b in by]), np.corrcoef([np.abs(a).mean() for a, _ in by], [np.abs(b).mean() for _, b in by])[0, 1]]
    assert math.isclose(got.score, np.mean(parts), rel_tol=1e-9)
    empty = evaluation.full_summary(df.limit(0), records.limit(0), evaluation.METRICS).first()
    assert empty.n_conditions == 0 and empty.pds is None and empty.css is None and empty.mse is None


def test_metrics_of_a_subset_and_unmarked_conditions(spark):
    data = predicted(2) + [("r", "z", None, 0, 1.0, 2.0, 0.5)]
    df = spark.createDataFrame(data, ROWS)
    half = spark.createDataFrame([(f,) for f in range(1, 12, 2)], "feature_id int")
    marks = df.where("drug = 'a' and feature_id < 3").select("population", "drug", "dose", "feature_id")
    got = {(r.population, r.drug, r.dose): r for r in evaluation.all_metrics(df, half, marks, 2).collect()}
    held = arrays(data[:-1])
    assert got.keys() == held.keys()  # the last condition has none of the features
    for k, (p, o, c) in held.items():
        q = slice(1, None, 2)
        assert math.isclose(got[k].mse, ((p - o)[q] ** 2).mean(), rel_tol=1e-9) and math.isclose(got[k].wasserstein, np.abs(np.sort(p[q]) - np.sort(o[q])).mean(), rel_tol=1e-9)
        if k[1] == "a":
            order = np.argsort(-np.abs(p - c), kind="stable")
            hit = np.isin(order, [0, 1, 2])
            area = sum(hit[:i].sum() for i in range(12) if not hit[i]) / (3 * 9)
            assert got[k].n_marks == 3 and math.isclose(got[k].deg_auroc, area, rel_tol=1e-9)
        else:
            assert got[k].n_marks == 0 and got[k].deg_auroc is None and got[k].deg_overlap == 0


def test_rankings_with_small_differences_and_faults(spark):
    base = [("p", "a", 1.0, f, 1e-12 * f, float(f), 0.0) for f in range(6)]
    marks = spark.createDataFrame([("p", "a", 1.0, 5), ("p", "a", 1.0, 4), ("p", "n", 1.0, 0)], "population string, drug string, dose double, feature_id int")
    bad = [("p", "n", 1.0, 0, float("nan"), 1.0, 0.0), ("p", "n", 1.0, 1, 1.0, 1.0, 0.0)]
    got = {r.drug: r for r in distances.deg_ranking(spark.createDataFrame(base + bad, ROWS), marks, 2).collect()}
    assert got["a"].deg_auroc == 1.0 and got["a"].deg_overlap == 1.0 and got["n"].deg_auroc is None and got["n"].deg_auprc is None


def test_no_correlation_without_variation(spark):
    flat = spark.createDataFrame([("p", "a", 1.0, f, 2.0, float(f), 1.0) for f in range(4)], ROWS)
    got = responses.biological(flat).first()
    assert got.pearson is None and got.direction == 0.5
    one = evaluation.biological_score(flat).first()
    assert one.mean_pearson is None and one.magnitude_pearson is None and one.score == 0.5


def test_exported_arrays(spark):
    data = predicted(4, 7)
    df = evaluation.exported(spark.createDataFrame(data, ROWS).repartition(4))
    held = arrays(data)
    got = {(r.population, r.drug, r.dose): r for r in evaluation.analyze_predictions(df).collect()}
    for k, (p, o, c) in held.items():
        assert math.isclose(got[k].r2, 1 - ((p - o) ** 2).sum() / ((o - o.mean()) ** 2).sum(), rel_tol=1e-9) and math.isclose(got[k].pcc_logfc, np.corrcoef(p - c, o - c)[0, 1], rel_tol=1e-9)
        assert math.isclose(got[k].direction_accuracy, np.mean(np.sign(p - c) == np.sign(o - c)))
    odd = spark.createDataFrame([(1, [1.0, 1.0], [2.0, 2.0], [0.0, 0.0]), (2, [], [], [])], "condition_id int, predicted array<double>, observed array<double>, control array<double>")
    found = {r.condition_id: r for r in evaluation.analyze_predictions(odd).collect()}
    assert found[1].r2 is None and found[1].pcc_logfc is None and found[1].mse == 1.0 and found[2].mse is None
    given = df.withColumn("true_deg_ids", F.when(F.col("drug") == "a", F.array(F.lit(6), F.lit(2), F.lit(0))).when(F.col("drug") == "b", F.array().cast("array<int>")))
    for r in evaluation.analyze_degs(given, (2, 50)).collect():
        p, o, c = held[r.population, r.drug, r.dose]
        true = np.array([6, 2, 0])[: r.top_k] if r.drug == "a" else np.argsort(-np.abs(o - c), kind="stable")[: r.top_k]
        near = np.argsort(-np.abs(p - c), kind="stable")[: r.top_k]
        assert math.isclose(r.overlap, len(set(true) & set(near)) / len(true)) and math.isclose(r.direction_accuracy, np.mean(np.sign((p - c)[true]) == np.sign((o - c)[true])))
        assert (r.deg_source == "exported_true_deg_ids") == (r.drug == "a")
    assert {r.top_k for r in evaluation.deg_summary(evaluation.analyze_degs(df, (2, 50))).collect()} == {2, 50} and evaluation.analyze_degs(df.limit(0)).count() == 0
    assert [r.dose for r in evaluation.dose_response(df).collect()] == sorted(k[2] for k in held)
    heat = evaluation.response_heatmap(df, ["population", "drug", "dose"], 3, 5).collect()
    assert len(heat) == 15 and max(abs(r.value) for r in heat) == 1.0
    assert evaluation.response_scatter(df, ["population", "drug", "dose"], 2, 3).count() == 2 * 4 and evaluation.response_heatmap(df.limit(0), ["drug"]).count() == 0


def test_keys_and_components_of_combinations(spark):
    raw = spark.createDataFrame([("A", "B", 1.0, 2.5, "C", "N"), ("DMSO", "B", 0.0, 2.0, None, "N"), ("DMSO", "vehicle", 1.0, 1.0, None, None), ("B", "A", 3.0, 1.0, "N", "C")], "d1 string, d2 string, x1 double, x2 double, s1 string, s2 string")
    named = preparation.combo_drug_key(cleaning.row_components(raw, ["d1", "d2"], ["x1", "x2"], ["s1", "s2"]))
    assert sorted((r.drug, r.dose) for r in named.collect()) == [("C|N__dose_1,2.5", 1.0), ("C|N__dose_1,3", 1.0), ("DMSO_TF", 0.0), ("N", 2.0)]
    table = preparation.component_table(named).unionByName(spark.createDataFrame([("L", None, ["l"], ["S"], [9.0], "L")], "drug string, dose double, component_names array<string>, component_smiles array<string>, component_doses array<double>, combination_key string"))
    conditions = spark.createDataFrame([("p", "C|N__dose_1,2.5", 1.0, "C"), ("p", "L", 4.0, "S"), ("p", "other", 0.5, "O"), ("p", "N", 7.0, "N")], "population string, drug string, dose double, canonical_smiles string")
    got = {r.drug: r for r in preparation.enrich_components(conditions, table).collect()}
    assert got["C|N__dose_1,2.5"].component_names == ["A", "B"] and got["C|N__dose_1,2.5"].condition_key == "p|C|N|1,2.5"
    assert got["L"].component_doses == [9.0] and got["other"].component_names == ["other"] and got["other"].condition_key == "p|other|0.5" and got["N"].component_doses == [7.0]


def test_ids_and_alignment(spark):
    obs = spark.createDataFrame([(1, "p", "g", "a", 1.0, False), (2, "p", "g", "a", None, False), (3, "p", "g", "x", 0.0, True), (4, "q", "g", "a", 1.0, False)], OBS)
    conditions = census.condition_table(obs.where("population = 'p'"))
    got = {r.obs_id: r.condition_id for r in preparation.join_condition_ids(obs, conditions).collect()}
    assert got[3] == got[4] == -1 and sorted([got[1], got[2]]) == [0, 1]
    groups = preparation.pair_groups(obs, conditions).collect()
    assert len(groups) == 2 and all(r.n_rows == 1 and len(r.condition_ids) == 1 for r in groups)
    ids = spark.createDataFrame([(1,), (1,), (3,)], "obs_id long")
    assert preparation.align_by_id(obs, ids).count() == 2
    with pytest.raises(ValueError, match="without metadata"):
        preparation.align_by_id(obs, spark.createDataFrame([(9,)], "obs_id long"))
    with pytest.raises(ValueError, match="more than once"):
        preparation.align_by_id(obs.unionByName(obs.where("obs_id = 1")), ids)


def test_materialised_tables(spark, tmp_path):
    obs = spark.createDataFrame([(1, "p", "g", "a", 1.0, False), (2, "p", "g", "x", 0.0, True)], OBS)
    counts = spark.createDataFrame([(1, 5, 3.0), (1, 6, 1.0), (1, 7, 2.0)], "obs_id long, feature_id int, value double")
    selected = spark.createDataFrame([(6, 0), (8, 1)], "feature_id int, place int")
    paths = preparation.materialise_tables(obs, census.condition_table(obs), counts, selected, f"{tmp_path}/m", 2, pad_id=99)
    read = {name: {r.obs_id: r for r in spark.read.parquet(p).collect()} for name, p in paths.items()}
    assert read["cell_metadata"][2].condition_id == -1 and read["cell_metadata"][1].row_id == 0
    assert read["state_inputs"][1].features == [5, 7] and read["state_inputs"][2].features == [99, 99] and read["state_inputs"][2]["values"] == [0.0, 0.0]
    assert read["hvg_expression"][2].vector == [0.0, 0.0] and read["hvg_expression"][1].vector[0] > 0
    tokens = spark.createDataFrame([(1, 5, 1, 2.0)], "obs_id long, feature_id int, position int, value double")
    assert rows(features.padded_tokens(tokens, 3, 7, (1, 0.5))) == [(1, [1, 5, 7], [0.5, 2.0, 0.0])]
    preparation.write_metrics(spark.createDataFrame([("a", None)], "m string, v double"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["m", "v"]


def test_splits_by_rule(spark, tmp_path):
    obs = spark.createDataFrame([(i, f"p{i % 2}", "g", f"d{i % 5}", 1.0, i % 7 == 0) for i in range(140)], OBS)
    made = preparation.create_splits(obs, unprofiled_external=2, combination_external=1)
    assert set(made) == {"unprofiled_drug", "unseen_combination"}
    folders = preparation.write_splits(made, str(tmp_path))
    again = preparation.write_splits(preparation.create_splits(obs.limit(70), unprofiled_external=2, combination_external=1), str(tmp_path))
    assert folders == again and preparation.read_split(spark, folders["unprofiled_drug"], "unprofiled_drug").count() == 120  # used again
    with pytest.raises(ValueError, match="not one by"):
        preparation.read_split(spark, folders["unprofiled_drug"], "unseen_combination")
    components = obs.where("not is_control").select("obs_id", "population", F.array("drug").alias("components"))
    assert preparation.create_splits(obs, "combosciplex", components=components)["combosciplex"][1].groupBy("part").count().count() == 2
    assert preparation.split_id("unprofiled_drug", 2, 0.2, 42, ["b", "a"]).endswith("__drugs_a-b")
    for options in ({"rule": "none"}, {"rule": "unseen_combination", "external_drugs": ["d1"]}, {"rule": "combosciplex"}, {"internal_fraction": 1.0}):
        with pytest.raises(ValueError):
            preparation.create_splits(obs, **options)


def test_shapes_and_reports(spark):
    stored = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0]), ("a", None), ("b", [1.0]), ("d", [1.0]), (None, [1.0])], "population string, vector array<double>")
    declared = spark.createDataFrame([("a", 3, 2), ("b", 2, 1), ("c", 1, 1), ("d", 0, 1)], "population string, n_cells long, width int")
    assert rows(preparation.check_shapes(stored, declared)) == sorted([("a", "width", 2), ("b", "rows", 1), ("c", "missing", 0), ("d", "declared", 0), (None, "undeclared", 1)], key=repr)
    assert preparation.check_shapes(stored.limit(0), declared.limit(0)).count() == 0
    report = preparation.validation_report({"good": declared.limit(0), "bad": declared})
    found = {r["name"]: r for r in report.collect()}
    assert found["good"].passed and found["good"].examples == [] and found["bad"].n_faults == 4 and len(found["bad"].examples) == 4
    with pytest.raises(ValueError, match="bad"):
        preparation.require(report)
    preparation.require(report.where("passed"))
    with pytest.raises(ValueError):
        preparation.validation_report({})


def test_trend_is_well_conditioned(spark):
    """Means far from 1: raw power sums would lose the parabola; all observations as one group."""
    x = np.linspace(5.9, 6.1, 40)
    moments = spark.createDataFrame([("a", i, float(10**v), float(10 ** (1 + 0.5 * v + 3 * (v - 6) ** 2))) for i, v in enumerate(x)], "population string, feature_id int, mean double, variance double")
    for by in ("population", None):
        got = features.variance_trend(moments, by)
        assert all(math.isclose(r.reg_std**2, r.variance, rel_tol=1e-6) for r in got.collect()) and "_all" not in got.columns
    obs = spark.createDataFrame([(i, "p", "g", "x", 0.0, True) for i in range(30)], OBS)
    rng = np.random.default_rng(3)
    counts = spark.createDataFrame([(i, f, float(v)) for i in range(30) for f, v in enumerate(rng.poisson(3 + np.arange(25))) if v], "obs_id long, feature_id int, value double")
    one = [r.feature_id for r in features.select_variable(obs, counts, 5, by=None).collect()]
    assert one == [r.feature_id for r in features.select_variable(obs, counts, 5).collect()]


def test_library_size_and_names(spark):
    obs = spark.createDataFrame([(1,), (2,)], "obs_id long")
    counts = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, float("nan")), (3, 1, 1.0)], "obs_id long, feature_id int, value double")
    assert rows(features.library_size(obs, counts)) == [(1, 2.0), (2, 0.0)]
    df = spark.createDataFrame([("mock", "XXX"), (None, None)], "n string, s string")
    from obsidia.functions.text import null_like

    assert [tuple(r) for r in df.select(cleaning.is_control("n"), cleaning.is_control("n", known=("dmso",)), null_like("s", "xxx")).collect()] == [(True, False, None), (False, False, None)]
