"""Censuses of conditions, and the filter that keeps conditions of enough observations and caps the large ones."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONDITION = ("population", "drug", "dose")


def condition_census(obs: DataFrame) -> DataFrame:
    return obs.groupBy("population", "is_control", "drug", "dose", "match_group").agg(F.count("*").alias("n_cells"))


def population_census(obs: DataFrame) -> DataFrame:
    return obs.groupBy("population").agg(F.count("*").alias("n_cells"), F.count_if("is_control").alias("n_controls"))


def dataset_summary(obs: DataFrame, median_over: str = "observations") -> DataFrame:
    """One row of totals. The median dose is over treated observations, or over distinct conditions."""
    if median_over not in ("observations", "conditions"):
        raise ValueError("median_over is 'observations' or 'conditions'")
    treated = obs.where("not is_control")
    if median_over == "observations":
        doses = treated.groupBy("dose").agg(F.count("*").alias("w"))
    else:
        doses = treated.select(*CONDITION).distinct().groupBy("dose").agg(F.count("*").alias("w"))
    # doses are few distinct values: the exact percentile is taken with weights
    dose = doses.agg(F.min("dose").alias("dose_min"), F.expr("percentile(dose, 0.5, w)").alias("dose_median"), F.max("dose").alias("dose_max"))
    total = obs.agg(F.count("*").alias("n_cells"), F.count_if("is_control").alias("n_controls"), F.count_distinct("population").alias("n_populations"))
    distinct = treated.select(*CONDITION).distinct().agg(F.count("*").alias("n_conditions"), F.count_distinct("drug").alias("n_drugs"))
    return total.join(F.broadcast(distinct)).join(F.broadcast(dose))


def sample_order(column: str, seed: int) -> F.Column:
    """A reproducible random order, the same in any engine and for any partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")), 256)


def capped_sample(obs: DataFrame, keys, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each key, uniformly without replacement. Spark keeps cap rows of a key and task before the shuffle."""
    order = W.partitionBy(*keys).orderBy(sample_order("obs_id", seed), "obs_id")
    return obs.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= cap).drop("sample_rank")


def filter_conditions(obs: DataFrame, min_cells: int = 500, max_cells: int = 5000, seed: int = 42) -> DataFrame:
    """Observations of treated conditions with at least min_cells, and controls, of each condition (of controls: each
    population) at most max_cells. Null key values are conditions of their own."""
    if not 0 < min_cells <= max_cells:
        raise ValueError("0 < min_cells <= max_cells")
    treated = obs.where("not is_control")
    small = treated.groupBy(*CONDITION).agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).drop("n")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in CONDITION]
    kept = treated.alias("t").join(small.alias("s"), same, "left_semi")
    return capped_sample(kept, CONDITION, max_cells, seed).unionByName(capped_sample(obs.where("is_control"), ["population"], max_cells, seed))


def filter_report(obs: DataFrame, min_cells: int = 500, max_cells: int = 5000) -> DataFrame:
    """Per population: source, retained, dropped and capped conditions, and their observations."""
    sizes = obs.where("not is_control").groupBy(*CONDITION).agg(F.count("*").alias("n"))
    kept = F.col("n") >= min_cells
    return sizes.groupBy("population").agg(
        F.count("*").alias("source_conditions"),
        F.count_if(kept).alias("retained_conditions"),
        F.count_if(~kept).alias("dropped_conditions"),
        F.count_if(F.col("n") > max_cells).alias("capped_conditions"),
        F.sum("n").alias("source_cells"),
        F.sum(F.when(kept, F.least("n", F.lit(max_cells))).otherwise(0)).alias("retained_cells"),
    )


def condition_table(obs: DataFrame) -> DataFrame:
    """condition_id (rank of the key), the key and n_cells of treated conditions. Ranking is over conditions, not observations."""
    sizes = obs.where("not is_control").groupBy(*CONDITION).agg(F.count("*").alias("n_cells"))
    return sizes.withColumn("condition_id", F.row_number().over(W.orderBy(*CONDITION)) - 1)


def group_index(obs: DataFrame) -> DataFrame:
    """A dense number for each match group of a population."""
    groups = obs.select("population", "match_group").distinct()
    return groups.withColumn("group_index", F.dense_rank().over(W.partitionBy("population").orderBy("match_group")) - 1)
