"""Prepared tables: condition ids, components of conditions, tokens and vectors of cells, splits by rule, and their checks."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.functions.text import condition_key
from obsidia.operators import features, sampling, splits
from obsidia.operators.census import CONDITION
from obsidia.operators.significance import _null_safe

#: The rules by which splits are made, and the one that stands for all of them.
RULES, ALL = ("unprofiled_drug", "unseen_combination", "combosciplex"), "all"


def _short(x) -> F.Column:
    """A number without a trailing .0, as in 1 or 0.1."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def combo_drug_key(rows: DataFrame) -> DataFrame:
    """rows (combination_key, components, is_control) with drug and dose.

    The drug of several components is the key, `__dose_` and their doses by commas, so that pairs that differ in a dose alone
    stay apart; of one component the key alone; of a control DMSO_TF. The dose is the first component's, 0 for controls.
    """
    doses = F.array_join(F.transform("components", lambda c: _short(c["dose"])), ",")
    several = F.concat("combination_key", F.lit("__dose_"), doses)
    drug = F.when(F.col("is_control"), "DMSO_TF").when(F.size("components") > 1, several).otherwise(F.col("combination_key"))
    return rows.withColumns({"drug": drug, "dose": F.when(F.col("is_control"), 0.0).otherwise(F.get("components", F.lit(0))["dose"])})


def component_table(rows: DataFrame) -> DataFrame:
    """drug, dose, component_names, component_smiles, component_doses, combination_key: a row for each drug and dose of rows
    that `combo_drug_key` gives, controls left out."""
    part = lambda f: F.transform("components", lambda c: c[f])
    fields = F.struct(part("name").alias("component_names"), part("smiles").alias("component_smiles"), part("dose").alias("component_doses"), "combination_key")
    held = rows.where("not is_control").groupBy("drug", "dose").agg(F.min(fields).alias("m"))
    return held.select("drug", "dose", "m.*")


def enrich_components(conditions: DataFrame, table: DataFrame) -> DataFrame:
    """conditions (population, drug, dose, canonical_smiles) with component_names, component_smiles, component_doses,
    combination_key and condition_key.

    Components come from table (see `component_table`) by drug and dose or, where that has none, by drug alone if table has a
    row for it with a null dose; else the condition is its own single component.
    """
    fields = ("component_names", "component_smiles", "component_doses", "combination_key")
    named = lambda t, p: t.select(F.col("drug").alias(f"_{p}drug"), F.col("dose").alias(f"_{p}dose"), *(F.col(f).alias(f"{p}{f}") for f in fields))
    exact, loose = named(table.where("dose is not null"), "e_"), named(table.where("dose is null"), "l_")
    joined = conditions.join(exact, (F.col("drug") == F.col("_e_drug")) & (F.col("dose") == F.col("_e_dose")), "left").join(loose, F.col("drug") == F.col("_l_drug"), "left")
    own = {"component_names": F.array("drug"), "component_smiles": F.array("canonical_smiles"), "component_doses": F.array("dose"), "combination_key": F.col("drug")}
    out = joined.select(*conditions.columns, *(F.coalesce(f"e_{f}", f"l_{f}", own[f]).alias(f) for f in fields))
    return out.withColumn("condition_key", condition_key(F.col("population"), F.col("combination_key"), F.col("component_doses")))


def join_condition_ids(obs: DataFrame, conditions: DataFrame) -> DataFrame:
    """obs with condition_id, -1 for controls and for treated rows whose condition is not in conditions. Null keys match."""
    ids = conditions.select(*CONDITION, F.col("condition_id").alias("_id")).dropDuplicates(list(CONDITION))
    joined = _null_safe(obs, ids, list(CONDITION), "left")
    return joined.withColumn("condition_id", F.when(F.col("is_control"), -1).otherwise(F.coalesce("_id", F.lit(-1)))).drop("_id")


def align_by_id(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """The metadata of the observations (obs_id) that rows have, once each; ids without metadata are an error that names
    some. Repeated metadata of an id are an error as well, as they could not be told apart."""
    ids = rows.select("obs_id").distinct()
    lost = ids.join(metadata, "obs_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError("rows without metadata: " + ", ".join(str(r[0]) for r in lost))
    kept = metadata.join(ids, "obs_id", "left_semi")
    twice = kept.groupBy("obs_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("metadata that stand more than once: " + ", ".join(str(r[0]) for r in twice))
    return kept


def materialise_tables(obs: DataFrame, conditions: DataFrame, counts: DataFrame, selected: DataFrame, path: str, pad_length: int = 2048, target: float = 10_000.0, pad_id: int = 0) -> dict[str, str]:
    """Writes three tables under path and gives their folders: cell_metadata (row_id within the population, condition_id,
    group), state_inputs (tokens in order of value, padded to pad_length) and hvg_expression (vector over selected: feature_id,
    place). Each is a plain Parquet table by obs_id; all observations have a row in each."""
    numbered = join_condition_ids(sampling.row_numbers(obs), conditions)
    normal = features.log_normalise(counts, target)
    tokens = features.padded_tokens(features.feature_tokens(normal, pad_length), pad_length, pad_id)
    fill = lambda v, t: F.array_repeat(F.lit(v), pad_length).cast(t)
    inputs = obs.select("obs_id").join(tokens, "obs_id", "left").select("obs_id", F.coalesce("features", fill(pad_id, "array<int>")).alias("features"), F.coalesce("values", fill(0.0, "array<double>")).alias("values"))
    tables = {"cell_metadata": numbered, "state_inputs": inputs, "hvg_expression": sampling.dense_vector(normal, selected, obs)}
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


def write_predictions(exported: DataFrame, path: str) -> None:
    """Exported arrays as a Parquet table; one that exists already is an error."""
    exported.write.option("compression", "zstd").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metric table as CSV files with a header; nulls are empty."""
    metrics.write.csv(path, header=True)


def pair_groups(obs: DataFrame, conditions: DataFrame) -> DataFrame:
    """population, drug, dose, n_rows, condition_ids: treated observations of each group and its distinct conditions, sorted."""
    joined = join_condition_ids(obs.where("not is_control"), conditions).where("condition_id >= 0")
    return joined.groupBy(*CONDITION).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("condition_id")).alias("condition_ids"))


def split_id(rule: str, external, internal_fraction: float, seed: int, external_drugs=None, disjoint: bool = True) -> str:
    """A name that tells a rule and all that its result depends on."""
    named = "" if not external_drugs else "__drugs_" + "-".join(sorted(external_drugs))
    together = "__joint" if rule == "unseen_combination" and not disjoint else ""
    return f"{rule}__external_{external:g}__internal_{internal_fraction:g}__seed_{seed}{named}{together}"


def create_splits(obs: DataFrame, rule: str = ALL, external=None, internal_fraction: float = 0.2, seed: int = 42, external_drugs=None, disjoint: bool = True, components: DataFrame | None = None, unprofiled_external=16, combination_external=0.05) -> dict[str, tuple[str, DataFrame]]:
    """rule -> (name, parts) of the rule, or of every one of RULES.

    parts: obs_id, the condition or components, and part. The sizes held out are `external` for a single rule, else the
    defaults of each. The last rule trains on single components and needs components (obs_id, population, components); with
    `all` it is left out without them. Named drugs go with unprofiled_drug (or all) only.
    """
    if rule not in (ALL, *RULES):
        raise ValueError(f"no such rule: {rule}")
    if external_drugs and rule not in (ALL, "unprofiled_drug"):
        raise ValueError("drugs are named for unprofiled_drug only")
    if rule == "combosciplex" and components is None:
        raise ValueError("combosciplex needs the components of observations")
    if not 0 <= internal_fraction < 1:
        raise ValueError("the internal fraction is from 0 to under 1")
    size = lambda default: default if external is None or rule == ALL else external
    out = {}
    if rule in (ALL, "unprofiled_drug"):
        n = size(unprofiled_external)
        out["unprofiled_drug"] = split_id("unprofiled_drug", n, internal_fraction, seed, external_drugs), splits.split_unprofiled(obs, n, internal_fraction, seed, external_drugs)
    if rule in (ALL, "unseen_combination"):
        n = size(combination_external)
        out["unseen_combination"] = split_id("unseen_combination", n, internal_fraction, seed, disjoint=disjoint), splits.split_combination(obs, n, internal_fraction, seed, disjoint)
    if components is not None and rule in (ALL, "combosciplex"):
        out["combosciplex"] = split_id("combosciplex", 0.0, internal_fraction, seed), splits.split_seen_components(components, internal_fraction, seed)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_splits(made: dict[str, tuple[str, DataFrame]], path: str) -> dict[str, str]:
    """rule -> folder of each split, written as path/name/parts beside a table `about` (rule, split_id); one that is there in
    whole is used again."""
    out = {}
    for rule, (name, parts) in made.items():
        spark, folder = parts.sparkSession, f"{path}/{name}"
        if not _exists(spark, f"{folder}/about/_SUCCESS"):
            parts.write.mode("overwrite").parquet(f"{folder}/parts")
            spark.createDataFrame([(rule, name)], "rule string, split_id string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
        out[rule] = folder
    return out


def read_split(spark: SparkSession, folder: str, regime: str) -> DataFrame:
    """The parts of a written split; it is used under its own rule and name only, else it is an error."""
    about = spark.read.parquet(f"{folder}/about").first()
    if about is None or about["rule"] != regime:
        raise ValueError(f"a split by {about and about['rule']} is not one by {regime}")
    if folder.rstrip("/").rsplit("/", 1)[-1] != about["split_id"]:
        raise ValueError(f"{folder} does not hold {about['split_id']}")
    return spark.read.parquet(f"{folder}/parts")


def index_and_split(obs: DataFrame, conditions: DataFrame, path: str, **options) -> tuple[DataFrame, dict[str, str]]:
    """The groups of `pair_groups`, and the folders of the splits written by `create_splits` with the given options."""
    return pair_groups(obs, conditions), write_splits(create_splits(obs, **options), path)


def check_shapes(vectors: DataFrame, declared: DataFrame, column: str = "vector") -> DataFrame:
    """population, fault, n: stored arrays (population, column) against declared (population, n_cells, width).

    `rows`: n rows where n_cells differ; `width`: n arrays of another width, nulls among them; `missing`: a declared
    population without rows (n 0); `undeclared`: one with n rows that is not declared; `declared`: one whose n_cells or width
    is null or not positive (n 0), whose rows are not compared.
    """
    good = (F.col("n_cells") > 0) & (F.col("width") > 0)
    named = declared.select("population", "n_cells", "width", F.coalesce(good, F.lit(False)).alias("good"), F.lit(True).alias("known"))
    sizes = vectors.groupBy("population", F.coalesce(F.size(column), F.lit(-1)).alias("w")).agg(F.count("*").alias("n"))
    rows = sizes.groupBy("population").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("widths"))
    both = _null_safe(named, rows, ["population"], "full")
    n = F.coalesce("n", F.lit(0)).cast("long")
    other = F.aggregate(F.map_values(F.map_filter("widths", lambda w, _: w != F.col("width"))), F.lit(0).cast("long"), lambda a, b: a + b)
    fault = lambda name, when, count: F.when(when, F.struct(F.lit(name).alias("fault"), count.cast("long").alias("n")))
    found = F.array_compact(F.array(
        fault("undeclared", F.col("known").isNull(), n), fault("declared", F.col("known") & ~F.col("good"), F.lit(0)), fault("missing", F.col("good") & (n == 0), n),
        fault("rows", F.col("good") & (n > 0) & (n != F.col("n_cells")), n), fault("width", F.col("good") & (n > 0) & (other > 0), other),
    ))
    return both.select("population", F.explode(found).alias("e")).select("population", "e.fault", "e.n")


def validation_report(checks: dict[str, DataFrame]) -> DataFrame:
    """name, n_faults, passed, examples (at most 5 faults as JSON) of checks given as tables of violations."""
    out = None
    for name, faults in checks.items():
        counted = faults.agg(F.count(F.lit(1)).alias("n_faults"))
        some = faults.select(F.to_json(F.struct(*faults.columns)).alias("j")).orderBy("j").limit(5).agg(F.array_sort(F.collect_list("j")).alias("examples"))
        one = counted.crossJoin(F.broadcast(some)).select(F.lit(name).alias("name"), "n_faults", (F.col("n_faults") == 0).alias("passed"), "examples")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no checks")
    return out


def require(report: DataFrame) -> None:
    """An error that names the checks which failed, if any."""
    failed = [f"{r['name']} ({r['n_faults']})" for r in report.where("not passed").collect()]  # a row for each check
    if failed:
        raise ValueError("failed: " + json.dumps(failed))
