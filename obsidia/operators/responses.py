"""Controls, differential features and responses of conditions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.operators.blocks import BLOCK, dense, vectors
from obsidia.operators.census import CONDITION
from obsidia.operators.features import group_means, group_moments
from obsidia.operators.significance import benjamini_hochberg  # noqa: F401  kept here for those who import it from here
from obsidia.operators.summaries import correlation


def missing_controls(obs: DataFrame) -> DataFrame:
    """Treated (population, match_group) pairs without a control."""
    keys = ["population", "match_group"]
    return obs.where("not is_control").select(*keys).distinct().join(obs.where("is_control").select(*keys).distinct(), keys, "left_anti")


def matched_control_counts(obs: DataFrame) -> DataFrame:
    """Per condition: treated observations, and matched (treated, control) pairs, counted without building them."""
    per_group = obs.where("is_control").groupBy("population", "match_group").agg(F.count("*").alias("n_controls"))
    treated = obs.where("not is_control").groupBy(*CONDITION, "match_group").agg(F.count("*").alias("n"))
    joined = treated.join(per_group, ["population", "match_group"], "left")
    return joined.groupBy(*CONDITION).agg(F.sum("n").alias("n_treated"), F.sum(F.col("n") * F.coalesce("n_controls", F.lit(0))).alias("n_pairs"))


def control_means(obs: DataFrame, values: DataFrame) -> DataFrame:
    return group_means(obs.where("is_control"), values, ["population", "match_group"])


def pseudobulk(obs: DataFrame, values: DataFrame) -> DataFrame:
    return group_means(obs.where("not is_control"), values, list(CONDITION))


def train_mean(obs: DataFrame, values: DataFrame) -> DataFrame:
    """Per feature the mean over conditions of their mean vectors, each condition counting alike, zeros included."""
    bulk = pseudobulk(obs, values)
    n = obs.where("not is_control").select(*CONDITION).distinct().agg(F.count("*").alias("n_conditions"))
    return bulk.groupBy("feature_id").agg(F.sum("mean").alias("s")).join(F.broadcast(n)).select("feature_id", (F.col("s") / F.col("n_conditions")).alias("mean"))


def welch_top(obs: DataFrame, values: DataFrame, top_k: int = 50) -> DataFrame:
    """Per condition the top_k features by Welch's |t| against all controls of the population; ties go to the lesser id."""
    a = group_moments(obs.where("not is_control"), values, list(CONDITION))
    c = group_moments(obs.where("is_control"), values, ["population"]).select("population", "feature_id", F.col("n_cells").alias("n0"), F.col("mean").alias("m0"), F.col("variance").alias("v0"))
    delta = F.col("mean") - F.col("m0")
    error = F.sqrt(F.col("variance") / F.col("n_cells") + F.col("v0") / F.col("n0"))
    t = F.when(error > 0, delta / error).when(delta == 0, 0.0).when(delta > 0, float("inf")).otherwise(float("-inf"))
    scored = a.join(c, ["population", "feature_id"]).withColumn("t", t)
    rank = F.row_number().over(W.partitionBy(*CONDITION).orderBy(F.abs("t").desc(), "feature_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select(*CONDITION, "feature_id", "t", "rank")


def predictions(obs: DataFrame, values: DataFrame) -> DataFrame:
    """Per condition and feature of the vocabulary: observed mean, control mean of the population, and a prediction
    halfway between the control and the mean over all conditions."""
    seen = group_moments(obs.where("not is_control"), values, list(CONDITION)).select(*CONDITION, "feature_id", "n_cells", F.col("mean").alias("observed"))
    control = group_moments(obs.where("is_control"), values, ["population"]).select("population", "feature_id", F.col("mean").alias("control"))
    general = train_mean(obs, values).withColumnRenamed("mean", "general")
    joined = seen.join(control, ["population", "feature_id"]).join(general, "feature_id", "left")
    return joined.withColumn("predicted", (F.coalesce("general", F.lit(0.0)) + F.col("control")) / 2).drop("general")


def condition_metrics(rows: DataFrame, keys=CONDITION) -> DataFrame:
    """mse, r2, Pearson of values and of differences from control, and agreement of signs, in one pass over (keys, feature)."""
    p, o, c = F.col("predicted"), F.col("observed"), F.col("control")
    sst = F.var_pop(o) * F.count("*")
    return rows.groupBy(*keys).agg(
        F.avg((p - o) ** 2).alias("mse"),
        F.when(sst >= 1e-12, 1 - F.sum((p - o) ** 2) / sst).alias("r2"),
        correlation(p, o).alias("pearson"),
        correlation(p - c, o - c).alias("pearson_delta"),
        F.avg((F.signum(p - c) == F.signum(o - c)).cast("double")).alias("direction_accuracy"),
    )


def dose_merge(rows: DataFrame) -> DataFrame:
    """Doses of a (population, drug) merged: means weighted by observations."""
    w = F.col("n_cells")
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return rows.groupBy("population", "drug", "feature_id").agg(mean("predicted"), mean("observed"), mean("control"), F.count("*").alias("n_doses"))


def disentanglement(rows: DataFrame, side: str = "observed") -> DataFrame:
    """Of the differences of side (observed or predicted) from control: 1 - var(rest) / var(difference), in [0, 1], where the rest is what the means of population and drug leave; null
    under three (population, drug) rows."""
    d = rows.select("population", "drug", "feature_id", (F.col(side) - F.col("control")).alias("delta"))
    grand = F.avg("delta").over(W.partitionBy("feature_id"))
    rest = F.col("delta") + grand - F.avg("delta").over(W.partitionBy("feature_id", "population")) - F.avg("delta").over(W.partitionBy("feature_id", "drug"))
    out = d.withColumn("rest", rest).agg(F.var_pop("rest").alias("a"), F.var_pop("delta").alias("b"), F.count_distinct("population", "drug").alias("n"))
    return out.select(F.when((F.col("b") >= 1e-12) & (F.col("n") >= 3), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("a") / F.col("b")))).alias("disentanglement"))


def biological(rows: DataFrame) -> DataFrame:
    """Per population: correlation, sign agreement and magnitudes of the mean differences; no correlation (null) where either
    side hardly varies."""
    mean = rows.groupBy("population", "feature_id").agg(F.avg(F.col("predicted") - F.col("control")).alias("p"), F.avg(F.col("observed") - F.col("control")).alias("o"))
    return mean.groupBy("population").agg(correlation("p", "o").alias("pearson"), F.avg((F.signum("p") == F.signum("o")).cast("double")).alias("direction"), F.avg(F.abs("p")).alias("predicted_size"), F.avg(F.abs("o")).alias("observed_size"))


def discrimination(rows: DataFrame, distance: str = "euclidean", block: int = BLOCK, overall: bool = False) -> DataFrame:
    """Per population 1 - 2 * mean(rank / n): rank counts the observed vectors nearer to a prediction than its own, by more
    than 1e-12; n counts those that share a feature with it.

    distance is euclidean or cityblock. rows hold one row per condition and feature; features that either vector lacks, null
    or NaN values take no part. Rows without a population are left out. Conditions are dealt to blocks by a hash, and each
    pair of blocks of a population is compared in one task, so that pairs of conditions are no rows. With overall, conditions of
    all populations are compared with each other, and one row (pds) results.
    """
    if distance not in ("euclidean", "cityblock"):
        raise ValueError(f"no such distance: {distance}")
    key = F.concat_ws("|", *(["population"] if overall else []), "drug", F.col("dose").cast("string"))
    if overall:
        rows = rows.where("population is not null").withColumns({"drug": key, "dose": F.lit(None).cast("double"), "population": F.lit("all")})
        return discrimination(rows, distance, block).select("pds")
    named = rows.where("population is not null").select("population", key.alias("i"), "feature_id", "predicted", "observed")
    blocks_of = named.groupBy("population").agg(F.ceil(F.count_distinct("i") / block).cast("int").alias("blocks"))
    v = vectors(named, ["population", "i"], ["predicted", "observed"]).join(blocks_of, "population")
    v = v.withColumn("own", F.pmod(F.xxhash64("i"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = v.select("population", "i", F.lit(True).alias("asks"), F.col("own").alias("x"), F.col("other").alias("y"), "feature", "predicted", "observed")
    no_values = F.transform("observed", lambda _: F.lit(None).cast("double"))
    answers = v.select("population", "i", F.lit(False).alias("asks"), F.col("other").alias("x"), F.col("own").alias("y"), "feature", no_values.alias("predicted"), "observed")

    def ranks(part: pa.Table) -> pa.Table:
        asking = part.column("asks").to_numpy()
        names = np.array(part.column("i").to_pylist(), dtype=object)
        p, o = dense(part, ["predicted", "observed"], np.nan)
        seen, of = o[~asking], names[~asking]
        out = []
        for i in np.flatnonzero(asking):
            apart = lambda other: np.abs(p[i] - other) if distance == "cityblock" else (p[i] - other) ** 2  # noqa: E731, B023
            d = apart(seen)
            shared = ~np.isnan(d).all(axis=1) if d.shape[1] else np.zeros(len(d), dtype=bool)
            nearer = (np.nansum(d, axis=1) < np.nansum(apart(o[i])) - 1e-12) & shared & (of != names[i])
            out.append((part.column("population")[0].as_py(), names[i], int(nearer.sum()), int(shared.sum())))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["population", "i", "rank", "n"])

    counts = asks.unionByName(answers).withColumn("population", F.col("population").cast("string"))
    counts = counts.groupBy("population", "x", "y").applyInArrow(ranks, "population string, i string, rank long, n long")
    counts = counts.groupBy("population", "i").agg(F.sum("rank").alias("rank"), F.sum("n").alias("n"))
    kind = rows.schema["population"].dataType
    return counts.where("n > 0").groupBy(F.col("population").cast(kind).alias("population")).agg((1 - 2 * F.avg(F.col("rank") / F.col("n"))).alias("pds"))


def negative_condition(conditions: DataFrame) -> DataFrame:
    """For each condition the tier and the number of its best negatives: 0 same drug in another population, 1 another
    population, 2 another condition, or itself where it is the only one. Counted by keys; no pairs of conditions are built."""
    c = conditions.select("condition_id", "population", "drug")
    total = c.agg(F.count("*").alias("n"))
    by_pop = c.groupBy("population").agg(F.count("*").alias("n_pop"))
    by_drug = c.groupBy("drug").agg(F.count("*").alias("n_drug"))
    by_both = c.groupBy("population", "drug").agg(F.count("*").alias("n_both"))
    j = c.join(by_pop, "population").join(by_drug, "drug").join(by_both, ["population", "drug"]).join(F.broadcast(total))
    same, other, rest = F.col("n_drug") - F.col("n_both"), F.col("n") - F.col("n_pop"), F.greatest(F.col("n") - 1, F.lit(1))
    return j.select("condition_id", F.when(same > 0, 0).when(other > 0, 1).otherwise(2).alias("tier"), F.when(same > 0, same).when(other > 0, other).otherwise(rest).alias("n_negatives"))
