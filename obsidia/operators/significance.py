"""Rank-sum tests of conditions against controls, and differential features at a false discovery rate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.operators.census import CONDITION
from obsidia.operators.features import valid_values

#: Slices of an octave of values. A feature of a population is ordered slice by slice, so that no task orders all of it.
SLICES = 4
#: Chebyshev coefficients of the complementary error function, from the highest power on; relative error under 1.2e-7.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def two_sided(z) -> Column:
    """Probability that a standard normal variable is as far from 0 as z; null for a null z."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[0])
    for c in ERFC[1:]:
        series = series * t + c
    return t * F.exp(series - x * x)


def benjamini_hochberg(rows: DataFrame, keys, p: str = "p", total: str | None = None) -> DataFrame:
    """rows with q, the step-up adjusted p within keys; null and NaN count as 1.

    total, if given, is a column with the number of tests of the group, of which those without a row have p = 1.
    """
    clean = F.when(F.col(p).isNull() | F.isnan(p), 1.0).otherwise(F.col(p))
    by = W.partitionBy(*keys)
    n = F.col(total) if total else F.count("*").over(by)
    ranked = rows.withColumn("_p", clean).withColumn("_i", F.row_number().over(by.orderBy("_p"))).withColumn("_n", n)
    tail = by.orderBy("_i").rowsBetween(0, W.unboundedFollowing)
    return ranked.withColumn("q", F.least(F.min(F.col("_p") * F.col("_n") / F.col("_i")).over(tail), F.lit(1.0))).drop("_p", "_i", "_n")


def _null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """left joined with right by keys, null keys too, which are kept once."""
    named = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = left.join(named, same, how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(k, f"_{k}") for k in keys})
    return joined.drop(*(f"_{k}" for k in keys))


def rank_sum(obs: DataFrame, values: DataFrame, keys=CONDITION, matched: bool = False) -> DataFrame:
    """keys, feature_id, n1, n0, p1, z of the rank-sum test of each condition and feature against controls, by mean ranks.

    The controls of a condition are all of its population or, with matched, those of the match groups that its observations
    belong to. keys begin with the population; fewer of them than CONDITION pool doses. Rows: the features which the condition
    or one of its controls shows (p1: positive values of the condition); for all others both arms are zeros and z is 0.
    z is above 0 where the condition ranks above its controls; null without controls. No tie or continuity correction.

    Values are positive, zeros are not stored. The condition's observations rank among themselves alike whatever they are, so
    only the controls below and beside each value count. Controls are ordered once for a population (or match group) and
    feature: every distinct value of a condition reads its place there from a running count over both arms, and controls
    are never repeated for a condition. Non-finite, null and negative values count as zeros; observations without values
    too; null doses and match groups are values of their own.
    """
    keys = list(keys)
    arm = ["population", "match_group"] if matched else ["population"]
    treated = obs.where("not is_control")
    seen = valid_values(values).join(obs.select("obs_id", "is_control", *dict.fromkeys([*keys, *arm])), "obs_id")
    one = seen.where("not is_control").groupBy(*keys, "feature_id", "value").agg(F.count("*").alias("k1"))
    zero = seen.where("is_control").groupBy(*arm, "feature_id", "value").agg(F.count("*").alias("k0"))
    arms = treated.groupBy(*keys, *arm[1:]).agg(F.count("*").alias("n"))
    n0 = obs.where("is_control").groupBy(*arm).agg(F.count("*").alias("n0"))
    sizes = _null_safe(arms, n0, arm, "left").groupBy(*keys).agg(F.sum("n").alias("n1"), F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.count("*").alias("n_arms"))

    asked = _null_safe(one, arms.select(*keys, *arm[1:]), keys) if matched else one
    none = [k for k in keys if k not in arm]
    kinds = dict(obs.dtypes)
    both = asked.withColumn("k0", F.lit(0).cast("long")).unionByName(zero.select(*arm, "feature_id", "value", *(F.lit(None).cast(kinds[k]).alias(k) for k in none), F.lit(0).cast("long").alias("k1"), "k0"))
    both = both.withColumn("slice", F.floor(F.log2("value") * SLICES).cast("int"))
    place = [*arm, "feature_id", "slice"]
    lower = W.partitionBy(*arm, "feature_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = both.groupBy(*place).agg(F.sum("k0").alias("k")).withColumn("lower", F.coalesce(F.sum("k").over(lower), F.lit(0))).drop("k")
    here = W.partitionBy(*place).orderBy("value")
    upto = F.sum("k0").over(here.rangeBetween(W.unboundedPreceding, W.currentRow))
    beside = F.sum("k0").over(here.rangeBetween(W.currentRow, W.currentRow))
    read = _null_safe(both.withColumn("inside", upto - beside / 2).where("k1 > 0"), slices, place)
    won = read.groupBy(*keys, "feature_id").agg(F.sum(F.col("k1") * (F.col("lower") + F.col("inside"))).alias("won"), F.sum("k1").alias("k1"))
    shown = zero.groupBy(*arm, "feature_id").agg(F.sum("k0").alias("p0"))
    by_condition = _null_safe(arms.select(*dict.fromkeys([*keys, *arm])), shown, arm).groupBy(*keys, "feature_id").agg(F.sum("p0").alias("p0"))
    out = _null_safe(_null_safe(by_condition, won, [*keys, "feature_id"], "full"), sizes, keys)
    p1, zeros = F.coalesce(F.col("k1"), F.lit(0)) / F.col("n_arms"), F.col("n0") - F.coalesce(F.col("p0"), F.lit(0))
    u = F.coalesce("won", F.lit(0.0)) + p1 * zeros + (F.col("n1") - p1) * zeros / 2
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    z = F.when(n0 > 0, (u - n1 * n0 / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12))
    return out.select(*keys, "feature_id", "n1", "n0", p1.cast("long").alias("p1"), z.alias("z"))


def wilcoxon_deg(obs: DataFrame, values: DataFrame, fdr: float = 0.05, keys=CONDITION, matched: bool = True, vocabulary: DataFrame | None = None) -> DataFrame:
    """keys, feature_id, z, p, q, significant: the rank-sum test of `rank_sum`, q adjusted over the whole vocabulary.

    vocabulary (feature_id) defaults to the features that have values; values of others take no part. Features of the
    vocabulary that neither arm shows have p = 1 and are no rows, but count as tests. significant: q < fdr. Conditions
    without controls have null z and p, and q = 1. Cap the arms before, as with `capped_sample`.
    """
    if not 0 < fdr <= 1:
        raise ValueError("the false discovery rate is over 0 and at most 1")
    if vocabulary is not None:
        vocabulary = vocabulary.select("feature_id").distinct()
        values = values.join(vocabulary, "feature_id", "left_semi")
    named = valid_values(values).select("feature_id").distinct() if vocabulary is None else vocabulary
    tests = named.agg(F.count("*").alias("n_tests"))  # one row
    tested = rank_sum(obs, values, keys, matched).withColumn("p", two_sided("z")).crossJoin(F.broadcast(tests))
    adjusted = benjamini_hochberg(tested, keys, total="n_tests")
    return adjusted.select(*keys, "feature_id", "z", "p", "q", (F.col("q") < fdr).alias("significant"))
