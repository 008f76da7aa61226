"""Metadata cleaning, canonical files, evaluation documents, similar sets, vectors and fingerprints: every fault and edge case."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsidia.operators import graph, identity, metadata, vectors
from obsidia.sources import canonical, evaluations, sparse


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_by_alias(spark):
    assert metadata.choose_column(["Cell_Type", "x"], metadata.ALIASES["population"]) == "Cell_Type"
    assert metadata.choose_column(["a"], ["b"]) is None and metadata.choose_column(["a", "b"], ["b"], "a") == "a"
    for wanted, required in (("z", None), (None, "drug")):
        with pytest.raises(ValueError):
            metadata.choose_column(["a"], ["b"], wanted, required)
    df = spark.createDataFrame([("a", "b")], "cell_line string, drug string")
    with pytest.raises(ValueError):
        metadata.normalise_metadata(df, {"colour": "drug"})
    with pytest.raises(ValueError):
        metadata.normalise_metadata(df.drop("drug"))


def test_metadata_faults(spark):
    data = [("1", "L", " Aspirin ", "CC", "0.5", None, "g"), ("2", None, "DMSO", "CC", "9", None, None), ("3", "L", "b", " nan", "x", "TRUE", "g"), ("4", "L", "b", "xxx", "1", "no", "g"), ("5", "L", "c", None, None, None, "g"), ("6", "L", None, "C", "inf", None, "g")]
    df = spark.createDataFrame(data, "barcode string, cell_line string, treatment string, smiles string, concentration string, vehicle string, batch string")
    known = spark.createDataFrame([("B", "CCC"), (" b", "CC"), (None, "C"), ("c", "none")], "name string, SMILES string")
    clean, at = metadata.normalise_metadata(df, structures=known)
    assert at["cell_id"] == "barcode" and at["group"] == "batch"
    found = {r.cell_id: r for r in clean.collect()}
    assert tuple(found["1"])[1:] == ("L", "Aspirin", 0.5, "uM", "CC", False, "g", None)
    assert tuple(found["2"])[1:] == ("unknown", "DMSO", 0.0, "uM", "", True, "default", None)
    assert found["3"].control and found["3"].dose == 0.0 and found["4"].canonical_smiles == "CCC" and found["4"].fault is None
    assert found["5"].fault == "dose" and found["6"].fault == "dose" and found["6"].drug == ""
    assert rows(metadata.metadata_faults(clean)) == [("dose", "", 1), ("dose", "c", 1)]
    with pytest.raises(ValueError, match="dose"):
        metadata.checked(clean)
    assert metadata.checked(clean.where("fault is null")).count() == 4
    # other names of controls, a default dose, no structures
    more, _ = metadata.normalise_metadata(df.drop("concentration", "vehicle", "barcode"), default_dose=2.0, control_names=("aspirin",))
    got = {r.drug: r for r in more.collect()}
    assert got["Aspirin"].control and not got["DMSO"].control and got["DMSO"].dose == 2.0 and got["c"].fault == "structure" and got["c"].cell_id.startswith("cell-")
    assert metadata.normalise_metadata(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("smiles, doses, want", [
    ("C", "1", (["C"], [1.0], None)), ("['C', 'N']", None, (["C", "N"], [0.0, 0.0], None)), ('["C"," N "]', "0.5", (["C", "N"], [0.5, 0.5], None)),
    ("('C',)", "(2,)", (["C"], [2.0], None)), ("[['C', 'N']]", "[[1, 2]]", (["C", "N"], [1.0, 2.0], None)), ("[broken", "1", (["[broken"], [1.0], None)),
    (None, "1", ([], [1.0], "empty")), (" ", None, ([], [], "empty")), ("['C', 'N']", "[1, 2, 3]", (["C", "N"], [1.0, 2.0, 3.0], "length")), ("['C', ' ']", "1", (["C", ""], [1.0, 1.0], "structure")),
    ("C", "-1", (["C"], [-1.0], "dose")), ("C", "many", (["C"], [None], "dose")), ("C", "inf", (["C"], [math.inf], "dose")),
])
def test_component_texts(spark, smiles, doses, want):
    got = metadata.normalise_components(spark.createDataFrame([(smiles, doses)], "smiles string, doses string")).first()
    assert (got.component_smiles, got.component_doses, got.fault) == want


def test_component_arrays(spark):
    df = spark.createDataFrame([(["C", None], [1.0, 2.0]), (["C"], None), (None, [1.0])], "smiles array<string>, doses array<double>")
    assert [r.fault for r in metadata.normalise_components(df).collect()] == ["structure", None, "empty"]
    nested = spark.createDataFrame([([["C", "N"]], 3)], "smiles array<array<string>>, doses int")
    assert metadata.normalise_components(nested).first().component_doses == [3.0, 3.0]


def test_canonical_source(spark, tmp_path):
    raw = spark.createDataFrame([("1", "L", "DMSO", None, 5.0, "g"), ("2", "L", "a", "C", 0.1, "g"), ("3", "M", "a", "C", 0.1, None)], "obs_id string, cell_line string, drug string, smiles string, dose double, plate string")
    clean = metadata.checked(metadata.normalise_metadata(raw)[0])
    values = sparse.gather(spark.createDataFrame([(1, 4, 1.0), (1, 2, 3.0), (2, 4, 2.0), (9, 1, 1.0)], "obs_id long, feature_id int, value double"))
    cells, samples = canonical.obs_to_canonical(clean, values)
    genes = spark.createDataFrame([(2, "x"), (4, "y")], "token_id long, gene_symbol string")
    path = f"{tmp_path}/c"
    assert canonical.write_canonical(cells, samples, genes, path, 2) == {"n_cells": 3, "n_controls": 1, "n_values": 3, "n_empty": 1}
    back = {tuple(r)[2:] for r in canonical.scan_cells(spark, path).collect()}
    assert ("L", "control::L::g", "DMSO_TF", "", "g") in back and len(back) == 3
    assert sorted(map(tuple, canonical.scan_cells(spark, path, ["genes", "expressions"]).collect())) == [([], []), ([2, 4], [3.0, 1.0]), ([4], [2.0])]
    doses = {r["sample"]: (r.treatment.drug, r.treatment.dose) for r in canonical.scan_sample_metadata(spark, path).collect()}
    assert doses["control::L::g"] == ("DMSO_TF", 0.0) and ("a", 0.1) in doses.values() and len(doses) == 3
    report = canonical.schema_report(spark, path).first()
    assert report.n_rows == 3 and report.gene_count == 2 and report["columns"].split(",") == list(canonical.CELLS) and report.shards >= 2
    counts = canonical.shard_counts(spark, path).collect()
    assert sum(r.n_cells for r in counts) == 3 and len({r.file for r in counts}) == report.shards
    vocabulary = spark.createDataFrame([(2, 7), (4, 7), (5, 8)], "token_id int, target_id int")
    assert tuple(canonical.stats_summary(spark, path, vocabulary).first())[1:] == (3, 0, 3, 1)
    assert tuple(canonical.stats_summary(spark, path, vocabulary, ["none"]).first()) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        canonical.scan_cells(spark, path, ["colour"])
    with pytest.raises(Exception, match="already exists"):
        canonical.write_canonical(cells, samples, genes, path)
    faulty = clean.withColumn("canonical_smiles", F.lit(""))
    with pytest.raises(Exception, match="no structure of a"):
        canonical.obs_to_canonical(faulty, values)[0].collect()
    spark.createDataFrame([(1, "b"), (None, "c")], "gene_id int, gene_name string").write.parquet(f"{tmp_path}/d/metadata/gene_metadata.parquet")
    assert rows(canonical.scan_feature_metadata(spark, f"{tmp_path}/d")) == [(1, "b")]


def test_link_files(spark, tmp_path):
    links = tmp_path / "links.txt"
    links.write_text("protein1 protein2 combined_score\na b 900\nb a 950\na c 700\na a 999\na z 990\nb d 800\n")
    info = tmp_path / "info.tsv"
    info.write_text("#string_protein_id\tpreferred_name\tsize\na\tX\t1\nb\tY\t2\nc\tX\t1\nd\tY\t5\nz\tQ\t1\n")
    symbols = spark.createDataFrame([("X", 0), ("Y", 1)], "symbol string, feature_id long")
    edges, figures = canonical.read_ppi_edges(spark, str(links), str(info), symbols)
    assert rows(edges) == [(0, 1, 0.95), (1, 0, 0.95)] and figures.first().asDict() == {"raw_edges": 5, "mapped_proteins": 4, "mapped_features": 2, "undirected_edges": 1, "directed_edges": 2}
    links.write_text("protein1 protein2\na b\n")
    with pytest.raises(ValueError):
        canonical.read_ppi_edges(spark, str(links), str(info), symbols)
    kg = tmp_path / "kg.csv"
    kg.write_text("x_type,x_name,y_type,y_name,more\ndrug,A-1,gene/protein,G,1\n")
    assert rows(canonical.read_kg_edges(spark, str(kg))) == [("drug", "A-1", "gene/protein", "G")]
    kg.write_text("x_type,x_name\ndrug,A\n")
    with pytest.raises(ValueError):
        canonical.read_kg_edges(spark, str(kg))


def test_aliases(spark):
    drugs = spark.createDataFrame([("C", 0), ("N", 1)], "smiles string, drug_id long")
    names = spark.createDataFrame([("Drug A", "C"), ("drug-a", "N"), ("B", "N"), ("(x)", "N"), (None, "C")], "name string, smiles string")
    aliases = spark.createDataFrame([("b", "C"), ("other", "N")], "alias string, canonical_smiles string")
    assert rows(graph.alias_lookup(drugs, names, aliases)) == [("b", 0, "alias_table"), ("druga", 0, "condition_table"), ("other", 1, "alias_table")]
    assert rows(graph.alias_lookup(drugs, names)) == [("b", 1, "condition_table"), ("druga", 0, "condition_table")]
    with pytest.raises(ValueError, match="unknown structure"):
        graph.alias_lookup(drugs, names, spark.createDataFrame([("q", "O")], aliases.schema))
    with pytest.raises(ValueError):
        graph.alias_lookup(drugs, names, aliases.drop("alias"))


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.7, 0.8])
def test_similar_sets_equal_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    sets = {i: frozenset({0} | {rng.randint(1, 14) for _ in range(rng.randint(0, 9))}) for i in range(60)}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] + [(1, 0), (None, 3), (99, None)], "id long, token int").repartition(3)
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    heads = sorted(rep.values())
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): near(a, b) for a in heads for b in heads if a < b and near(a, b) > threshold} | {(rep[s], i): 1.0 for i, s in sets.items() if rep[s] != i}
    got = {(r.a, r.b): r.jaccard for r in graph.jaccard_pairs(df, threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert graph.jaccard_pairs(df, threshold, True).count() == 2 * len(want)
    assert graph.jaccard_pairs(df.limit(0), threshold).count() == 0


def test_common_token_pairs_nothing(spark):
    """One token of all sets beside two of its own each: with a threshold of one half no pair of rows is made."""
    df = spark.range(400).select("id", F.explode(F.array(F.lit(-1).cast("long"), F.col("id") * 2, F.col("id") * 2 + 1)).alias("token"))
    assert graph.jaccard_pairs(df, 0.5).count() == 0
    from obsidia.operators.graph import _least_shared

    assert [spark.range(1).select(_least_shared(F.lit(n), 0.5)).first()[0] for n in (1, 2, 3, 4)] == [1, 2, 2, 3]
    with pytest.raises(ValueError):
        graph.jaccard_pairs(df, 1.0)


def test_documents(spark, tmp_path):
    docs = {
        "run1/evaluations/e1/internal/evaluation.json": {"model": "m", "regime": "r", "evaluation_split": "internal", "split_id": "s", "summary": {"mse": {"mean": 1.5, "n": 3, "std": None}, "speed": 7, "note": "text", "bad": float("nan")}, "dose_level": {"summary": {"mse": {"mean": 2}}, "runs": 1}},
        "run1/evaluations/e2/evaluation.json": {"regime": "q", "summary": {}, "cell_line_drug": {"summary": {"r2": 0.5}}},
        "run2/with space/evaluation.json": {},
    }
    for name, doc in docs.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(doc, indent=1))
    read = evaluations.read_documents(spark, str(tmp_path), default_model="none")
    assert sorted((r.folder, r.model) for r in read.select("folder", "model").collect()) == [("e2", "none"), ("internal", "m"), ("with space", "none")]
    found = {(r.evaluation_id, r.evaluation_unit, r.metric): (r.statistics, r.value) for r in evaluations.collect_evaluations(read).collect()}
    assert found["e1:internal", "primary", "mse"] == ({"mean": 1.5, "n": 3.0, "std": None}, None) and found["e1:internal", "primary", "speed"] == (None, 7.0)
    assert found["e1:internal", "primary", "note"] == (None, None) and found["e1:internal", "dose_level_condition", "mse"][0] == {"mean": 2.0} and found["e2", "cell_line_drug", "r2"] == (None, 0.5)
    assert len(found) == 6 and {r.evaluation_id for r in evaluations.collect_evaluations(read, ["q"]).collect()} == {"e2"}
    summary = {r.evaluation_id: r for r in evaluations.generalization_summary(read).collect()}
    assert len(summary["internal"]["summary"]) == 4 and summary["with space"]["summary"] == {} and summary["e2"].regime == "q"
    (tmp_path / "broken.json").write_text("{not json")
    with pytest.raises(Exception):
        evaluations.read_documents(spark, str(tmp_path)).select("model").collect()


def test_responses_and_embedding(spark):
    rng = np.random.default_rng(2)
    obs, values, means = [], [], np.zeros((6, 5))
    for i in range(240):
        drug = i % 6
        obs.append((i, "p", "g", f"d{drug}", 1.0 + i % 2, False))
        v = rng.poisson(2 + np.arange(5) * (drug + 1) % 7)
        values += [(i, f, float(x)) for f, x in enumerate(v) if x]
        means[drug] += v / 40
    df = spark.createDataFrame(obs, "obs_id long, population string, match_group string, drug string, dose double, is_control boolean")
    counts = spark.createDataFrame(values, "obs_id long, feature_id int, value double")
    drugs = df.select("drug").distinct()
    found = vectors.drug_responses(df, counts, drugs, most=1000)
    matrix = np.zeros((6, 5))
    for r in found.collect():
        matrix[int(r.drug[1]), r.feature_id] = r.response
    centred = means - means.mean(axis=0)
    assert np.abs(matrix - centred).max() < 1e-9
    got = {r.drug: r.embedding for r in vectors.response_embedding(found, 8).collect()}
    e = np.array([got[f"d{i}"] for i in range(6)])
    _, _, right = np.linalg.svd(centred, full_matrices=False)
    want = centred @ right.T
    scale = want.std(axis=0)
    want = np.where(scale > 1e-8, want / np.where(scale > 1e-8, scale, 1), 0)
    for k in range(5):
        assert min(np.abs(e[:, k] - want[:, k]).max(), np.abs(e[:, k] + want[:, k]).max()) < 1e-6
    assert (e[:, 5:] == 0).all()
    with pytest.raises(ValueError, match="other"):
        vectors.drug_responses(df, counts, drugs.unionByName(spark.createDataFrame([("other",)], "drug string")))
    assert vectors.drug_responses(df, counts, drugs, most=1).count() == 30
    with pytest.raises(ValueError):
        vectors.drug_responses(df, counts, drugs, 0)


def test_standardise(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, float("nan"), 2.0]), (2, [3.0, 5.0, 1.0, 2.005]), (3, None), (4, [5.0, 5.0, None, 2.0])], "id int, vector array<double>")
    got = {r.id: r for r in vectors.standardise(df).collect()}
    assert got[1].kept == [0, 2] and got[3].vector is None
    assert np.allclose([got[i].vector for i in (1, 2, 4)], [[-1, -1 / math.sqrt(3)], [0, 2 / math.sqrt(3)], [1, -1 / math.sqrt(3)]])
    with pytest.raises(Exception, match="widths"):
        vectors.standardise(df.unionByName(spark.createDataFrame([(5, [1.0])], df.schema))).collect()
    with pytest.raises(Exception, match="no component"):
        vectors.standardise(df.where("id = 1")).collect()


def test_part_faults(spark):
    schema = "row_id long, vector array<double>, source string"
    n = 3 * vectors.STRETCH + 10
    held = [0, 1, 1, 2, 5, vectors.STRETCH - 1, vectors.STRETCH + 1, 3 * vectors.STRETCH, n, None, -4]
    df = spark.createDataFrame([(i, [1.0] * (2 if i == 5 else 3), "b" if i == 2 else "a") for i in held], schema).repartition(3)
    s = vectors.STRETCH
    assert rows(vectors.part_faults(df, n)) == sorted([
        ("gap", 3, 4, 2), ("gap", 6, s - 2, s - 7), ("gap", s, s, 1), ("gap", s + 2, 3 * s - 1, 2 * s - 2), ("gap", 3 * s + 1, n - 1, 9),
        ("outside", -4, -4, 1), ("outside", None, None, 1), ("outside", n, n, 1), ("repeat", 1, 1, 2), ("source", 2, 2, 1), ("width", 5, 5, 1),
    ], key=repr)
    whole = spark.range(70_000).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("vector"), F.lit("a").alias("source"))
    assert vectors.part_faults(whole, 70_000).count() == 0 and vectors.merge_parts(whole, 70_000).count() == 70_000
    with pytest.raises(ValueError, match="gap"):
        vectors.merge_parts(whole.where("row_id <> 9"), 70_000)
    assert rows(vectors.part_faults(df.limit(0), 3)) == [("gap", 0, 2, 3)] and vectors.part_faults(df.limit(0), 0).count() == 0


def test_fingerprints(spark):
    df = spark.range(2500).select(F.col("id").alias("place"), (F.col("id") * 7 % 2503).alias("feature_id"))
    digest = lambda d, **p: identity.feature_fingerprint(d, p).first()
    one = digest(df, a=1, b=[1, 2])
    assert one.n == 2500 and one == digest(df.repartition(7), b=[1, 2], a=1) == digest(df.orderBy(F.desc("place")).coalesce(1), a=1, b=[1, 2])
    swapped = df.withColumn("place", F.when(F.col("place") == 3, 2000).when(F.col("place") == 2000, 3).otherwise(F.col("place")))
    others = [digest(swapped, a=1, b=[1, 2]), digest(df, a=1, b=[2, 1]), digest(df.where("place < 2499"), a=1, b=[1, 2]), digest(df.withColumn("feature_id", F.when(F.col("place") != 5, F.col("feature_id"))), a=1, b=[1, 2])]
    assert len({one.fingerprint, *(o.fingerprint for o in others)}) == 5
    with pytest.raises(Exception, match="without a place"):
        digest(df.withColumn("place", F.lit(None).cast("long")))
    assert digest(df.limit(0)).n == 0
