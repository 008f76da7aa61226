"""Vectors of drugs and of cells: responses and their main directions, standardised columns, and parts to be merged."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.operators.census import CONDITION, capped_sample
from obsidia.operators.features import valid_values
from obsidia.sources.shared import checkpointed

#: Ids that are looked at together for gaps; the borders of these stretches are compared afterwards.
STRETCH = 1 << 16


def chosen_observations(obs: DataFrame, drugs: DataFrame, most: int = 32, seed: int = 42) -> DataFrame:
    """obs_id, drug: the observations that `drug_responses` takes, at most `most` of each condition; computed once."""
    wanted = drugs.select("drug").where("drug is not null").distinct()
    treated = obs.where("not is_control").join(wanted, "drug", "left_semi")
    return checkpointed(capped_sample(treated, CONDITION, most, seed).select("obs_id", "drug"))


def drug_responses(obs: DataFrame, values: DataFrame, drugs: DataFrame, most: int = 32, seed: int = 42, chosen: DataFrame | None = None) -> DataFrame:
    """drug, feature_id, response: the mean over at most `most` treated observations of each of a drug's conditions, zeros
    included, less the mean of all drugs; a row for each drug (of `drugs`) and feature that any of them shows.

    The observations of a condition are chosen by a seeded order; chosen may hold them already (`chosen_observations`). A drug
    without observations is an error.
    """
    if most < 1:
        raise ValueError("at least one observation of a condition")
    wanted = drugs.select("drug").where("drug is not null").distinct()
    chosen = chosen_observations(obs, drugs, most, seed) if chosen is None else chosen
    sizes = wanted.join(chosen.groupBy("drug").agg(F.count("*").alias("n")), "drug", "left")
    missing = sizes.where("n is null").select("drug").limit(8).collect()
    if missing:
        raise ValueError(f"drugs without a response, such as {', '.join(r['drug'] for r in missing)}")
    sums = valid_values(values).join(chosen, "obs_id").groupBy("drug", "feature_id").agg(F.sum("value").alias("total"))
    means = sums.join(sizes, "drug").select("drug", "feature_id", (F.col("total") / F.col("n")).alias("mean"))
    size = sizes.agg(F.count("*").alias("n_drugs"))
    centre = means.groupBy("feature_id").agg(F.sum("mean").alias("all")).crossJoin(F.broadcast(size)).select("feature_id", (F.col("all") / F.col("n_drugs")).alias("centre"))
    # drugs x features is the size of the result
    every = wanted.crossJoin(centre)
    return every.join(means, ["drug", "feature_id"], "left").select("drug", "feature_id", (F.coalesce("mean", F.lit(0.0)) - F.col("centre")).alias("response"))


def response_embedding(responses: DataFrame, n_components: int = 10) -> DataFrame:
    """drug, embedding: coordinates of the drugs' centred responses on their main directions, each of unit deviation.

    The directions come from the features' covariance, summed by Spark; at most 65,535 features. Each points to where its
    largest weight is positive. Directions in which the drugs do not differ, and those beyond the number of features, are 0.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if n_components < 1:
        raise ValueError("at least one component")
    rows = responses.groupBy("drug").agg(F.array_sort(F.collect_list(F.struct("feature_id", "response"))).alias("v")).select("drug", array_to_vector(F.col("v.response")).alias("v"))
    rows = checkpointed(rows)  # a row for each drug, read several times below
    head = rows.select(F.size(vector_to_array("v")).alias("n")).first()
    zero = F.array_repeat(F.lit(0.0), n_components)
    if head is None:
        return rows.select("drug", zero.alias("embedding"))
    k = min(n_components, head["n"])
    model = PCA(k=k, inputCol="v", outputCol="c").fit(rows)
    weights = model.pc.toArray()
    signs = [1.0 if weights[abs(weights[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    placed = model.transform(rows).select("drug", vector_to_array("c").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    scale = placed.agg(F.array(*(F.stddev_pop(at(i)) for i in range(k))).alias("scale"), F.array(*(F.avg(at(i)) for i in range(k))).alias("mean"))
    units = [F.when(F.get("scale", F.lit(i)) > 1e-8, signs[i] * (at(i) - F.get("mean", F.lit(i))) / F.get("scale", F.lit(i))).otherwise(0.0) for i in range(k)]
    return placed.crossJoin(F.broadcast(scale)).select("drug", F.array(*units, *[F.lit(0.0)] * (n_components - k)).alias("embedding"))


def standardise(vectors: DataFrame, column: str = "vector", least: float = 0.01) -> DataFrame:
    """vectors with `column` standardised, and kept, the places (from 0) of the components that stay.

    Components that are null, NaN or infinite count as 0; those with a sample deviation of at most `least` are dropped, the
    others get mean 0 and deviation 1. Null vectors stay null. Vectors of different widths, and none that varies, are errors.
    """
    x = F.transform(column, lambda e: F.when(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")), 0.0).otherwise(e.cast("double")))
    each = vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("width"), F.posexplode(x).alias("at", "e"))
    stats = each.groupBy("at").agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.min("width").alias("lo"), F.max("width").alias("hi"))
    stays = F.filter(F.array_sort(F.collect_list(F.struct("at", "mean", "sd"))), lambda s: s["sd"] > least)
    one = stats.agg(stays.alias("stats"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))  # one row, as wide as a vector
    fault = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("the vectors have different widths"))).when(F.size("stats") == 0, F.raise_error(F.lit("no component varies")))
    one = one.select(F.coalesce(fault.cast("array<struct<at:int,mean:double,sd:double>>"), F.col("stats")).alias("_stats"))
    scaled = F.when(F.col("_x").isNotNull(), F.transform("_stats", lambda s: (F.get("_x", s["at"]) - s["mean"]) / s["sd"]))
    return vectors.withColumn("_x", x).crossJoin(F.broadcast(one)).select(*(scaled.alias(c) if c == column else F.col(f"`{c}`") for c in vectors.columns), F.col("_stats.at").alias("kept"))


def part_faults(parts: DataFrame, n_rows: int) -> DataFrame:
    """fault, first, last, n: what keeps parts (row_id, source, vector) from being one table of the ids 0 to n_rows - 1.

    `gap`: a stretch of n ids without a row; `repeat`: an id with n rows; `outside`: an id beyond the range, or null; `source`
    and `width`: n rows whose source or width is not the most frequent one (of equals the least), from the first to the last
    id. Ids are looked at by stretches of STRETCH; gaps between stretches come from their first and last ids. No list of
    all ids is made, and the border comparison goes over one row for each stretch that holds an id.
    """
    ids = parts.groupBy("row_id").agg(F.count("*").alias("n"))
    inside = ids.where((F.col("row_id") >= 0) & (F.col("row_id") < n_rows)).select("row_id", F.expr(f"row_id div {STRETCH}").alias("stretch"))
    row = lambda fault, first, last, n: (F.lit(fault).alias("fault"), first.cast("long").alias("first"), last.cast("long").alias("last"), n.cast("long").alias("n"))
    gap = lambda before, after: row("gap", before + 1, after - 1, after - before - 1)
    here = inside.withColumn("before", F.lag("row_id").over(W.partitionBy("stretch").orderBy("row_id")))
    within = here.where("row_id - before > 1").select(*gap(F.col("before"), F.col("row_id")))
    ends = inside.groupBy("stretch").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    borders = ends.withColumn("before", F.lag("hi", 1, -1).over(W.orderBy("stretch"))).where("lo - before > 1").select(*gap(F.col("before"), F.col("lo")))
    top = inside.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("top")).where(F.col("top") < n_rows - 1).select(*gap(F.col("top"), F.lit(n_rows)))
    repeats = ids.where((F.col("n") > 1) & (F.col("row_id") >= 0) & (F.col("row_id") < n_rows)).select(*row("repeat", F.col("row_id"), F.col("row_id"), F.col("n")))
    outside = ids.where(F.col("row_id").isNull() | (F.col("row_id") < 0) | (F.col("row_id") >= n_rows)).select(*row("outside", F.col("row_id"), F.col("row_id"), F.col("n")))

    def odd(fault, value):
        kinds = parts.groupBy(value.alias("v")).agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
        most = kinds.crossJoin(F.broadcast(kinds.agg(F.max("n").alias("most")))).where("n = most").agg(F.min("v").alias("usual"))
        return kinds.crossJoin(F.broadcast(most)).where(~F.col("v").eqNullSafe(F.col("usual"))).select(*row(fault, F.col("first"), F.col("last"), F.col("n")))

    out = within
    for more in (borders, top, repeats, outside, odd("source", F.col("source")), odd("width", F.size("vector"))):
        out = out.unionByName(more)
    return out


def merge_parts(parts: DataFrame, n_rows: int) -> DataFrame:
    """parts, if `part_faults` finds nothing; else an error that names the first faults."""
    faults = part_faults(parts, n_rows).orderBy("fault", "first").limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r['fault']} {r['first']} to {r['last']}" for r in faults))
    return parts
