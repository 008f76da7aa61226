"""Checks as tables of violations: no rows, no fault. Null counts and values are violations where a number is due."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def condition_bounds(conditions: DataFrame, least: int, most: int) -> DataFrame:
    """Conditions (.., n_cells) with fewer or more observations than allowed, and why."""
    n = F.col("n_cells")
    fault = F.when(n.isNull(), "null").when(n < least, "few").when(n > most, "many")
    return conditions.withColumn("fault", fault).where("fault is not null")


def non_finite(values: DataFrame) -> DataFrame:
    """obs_id, n_bad of observations with null, NaN or infinite values."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return values.groupBy("obs_id").agg(F.count_if(bad).alias("n_bad")).where("n_bad > 0")


def vocabulary(values: DataFrame, known: DataFrame) -> DataFrame:
    """feature_id, fault: features without a place in known (feature_id), and known ones without values."""
    used, named = values.select("feature_id").distinct(), known.select("feature_id").distinct()
    unknown = used.join(named, "feature_id", "left_anti").withColumn("fault", F.lit("unknown"))
    return unknown.unionByName(named.join(used, "feature_id", "left_anti").withColumn("fault", F.lit("unused")))


def row_membership(obs: DataFrame, conditions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fault: conditions without observations, and treated observations' conditions that are not in the table."""
    seen, named = obs.where("not is_control").select(*keys).distinct(), conditions.select(*keys).distinct()
    empty = named.join(seen, keys, "left_anti").withColumn("fault", F.lit("empty"))
    return empty.unionByName(seen.join(named, keys, "left_anti").withColumn("fault", F.lit("not listed")))
