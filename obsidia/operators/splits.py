"""Leakage-free train, internal-test and external-test parts."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.operators.census import CONDITION, sample_order


def holdout_count(value, total: int) -> int:
    """A fraction of total, at least 1, or a whole number."""
    if value <= 0:
        raise ValueError("a holdout is positive")
    return value if isinstance(value, int) else max(1, round(value * total))


def group_split(obs: DataFrame, external: DataFrame, keys, internal_fraction: float = 0.2, cap: int | None = 5000, seed: int = 42) -> DataFrame:
    """obs_id, the condition and part of at most cap treated observations of each condition, or of all without a cap.

    external holds the keys held out. Elsewhere the first floor(n * (1 - internal_fraction)) by a seeded order train.
    """
    by = W.partitionBy(*CONDITION)
    treated = obs.where("not is_control").join(external.select(*keys, F.lit(True).alias("out")), list(keys), "left")
    ranked = treated.withColumn("rank", F.row_number().over(by.orderBy(sample_order("obs_id", seed), "obs_id")))
    if cap is not None:
        ranked = ranked.where(F.col("rank") <= cap)
    n = F.count("*").over(by)
    part = F.when(F.col("out"), "external").when(F.col("rank") <= F.floor(n * (1 - internal_fraction) + 1e-9), "train").otherwise("internal")
    return ranked.select("obs_id", *CONDITION, part.alias("part"))


def split_unprofiled(obs: DataFrame, external_test_size, internal_fraction: float = 0.2, seed: int = 42, external_drugs=None) -> DataFrame:
    """Whole drugs held out: those named, or a seeded choice. Training drugs must be left."""
    drugs = obs.where("not is_control").select("drug").distinct()
    total = drugs.count()
    if external_drugs:
        chosen = drugs.where(F.col("drug").isin(list(external_drugs)))
        n = chosen.count()
    else:
        n = holdout_count(external_test_size, total)
        chosen = drugs.orderBy(sample_order("drug", seed), "drug").limit(n)
    if not 0 < n < total:
        raise ValueError(f"{n} of {total} drugs held out")
    return group_split(obs, chosen, ["drug"], internal_fraction, seed=seed)


def split_combination(obs: DataFrame, external_test_size, internal_fraction: float = 0.2, seed: int = 42, disjoint: bool = True, cap: int | None = 5000) -> DataFrame:
    """(population, drug) pairs held out; with disjoint no drug is held out in two populations. Populations with fewer drugs
    choose first. Only this choice, over the table of pairs, runs in the driver. cap as in `group_split`."""
    pairs = obs.where("not is_control").select("population", "drug", sample_order("drug", seed).alias("o")).distinct()
    by_population: dict = {}
    for r in pairs.orderBy("population", "o", "drug").toLocalIterator():
        by_population.setdefault(r["population"], []).append(r["drug"])
    used, held = set(), []
    for population, drugs in sorted(by_population.items(), key=lambda kv: (len(kv[1]), kv[0])):
        n = external_test_size if isinstance(external_test_size, int) else max(1, math.floor(external_test_size * len(drugs)))
        free = [d for d in drugs if not (disjoint and d in used)]
        if len(free) < n or n >= len(drugs):
            raise ValueError(f"{population}: {n} drugs to hold out, {len(free)} free of {len(drugs)}")
        held += [(population, d) for d in free[:n]]
        used.update(free[:n])
    external = obs.sparkSession.createDataFrame(held, "population string, drug string")
    return group_split(obs, external, ["population", "drug"], internal_fraction, cap, seed)


def split_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count_distinct(*CONDITION).alias("n_conditions"), F.count("*").alias("n_rows"))


def overlapping_rows(parts: DataFrame) -> DataFrame:
    """Observations in more than one part: the violations of disjointness."""
    return parts.groupBy("obs_id").agg(F.count_distinct("part").alias("n_parts")).where("n_parts > 1")


def split_seen_components(obs: DataFrame, internal_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """obs_id, population, components and part: single-component conditions train, longer ones are held out.

    obs: obs_id, population, components (sorted array). Of a single-component condition the first
    floor(n * (1 - internal_fraction)) observations by a seeded order are `train`, the rest `internal`. A combination is
    `both_seen`, `one_seen` or `both_unseen` as all, some or none of its components are known from single ones. Rows
    without components are left out. The fraction may be 0.
    """
    if not 0 <= internal_fraction < 1:
        raise ValueError("the internal fraction is from 0 to under 1")
    rows = obs.select("obs_id", "population", "components")
    single, several = rows.where(F.size("components") == 1), rows.where(F.size("components") > 1)
    by = W.partitionBy("population", "components")
    rank = F.row_number().over(by.orderBy(sample_order("obs_id", seed), "obs_id"))
    trains = rank <= F.floor(F.count("*").over(by) * (1 - internal_fraction) + 1e-9)
    one = single.withColumn("part", F.when(trains, "train").otherwise("internal"))
    seen = single.select(F.get("components", 0).alias("c")).distinct().withColumn("known", F.lit(1))
    kinds = several.select("components").distinct().withColumn("c", F.explode("components")).join(seen, "c", "left")
    kinds = kinds.groupBy("components").agg(F.count("known").alias("k"), F.count("*").alias("n"))
    label = F.when(F.col("k") == F.col("n"), "both_seen").when(F.col("k") == 0, "both_unseen").otherwise("one_seen")
    return one.unionByName(several.join(kinds.select("components", label.alias("part")), "components").select(*rows.columns, "part"))
