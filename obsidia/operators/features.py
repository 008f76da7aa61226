"""Feature statistics over sparse vectors, where an absent value is a zero, and selection of variable features."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid_values(counts: DataFrame) -> DataFrame:
    return counts.where("value > 0 and not isnan(value) and value < double('infinity')")


def feature_moments(obs: DataFrame, counts: DataFrame, by: str | None = None) -> DataFrame:
    """n_cells, total, total of squares, max, mean and variance of every feature (of every group `by`), zeros included."""
    keys = [by] if by else []
    sizes = obs.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    values = valid_values(counts)
    every = values.select("feature_id").distinct()
    every = sizes.join(F.broadcast(every))  # the vocabulary: one row per feature for each group, also where all are zero
    sums = values.join(obs.select("obs_id", *keys), "obs_id").groupBy(*keys, "feature_id").agg(F.sum("value").alias("total"), F.sum(F.col("value") ** 2).alias("squares"), F.max("value").alias("max_value"))
    out = every.join(sums, [*keys, "feature_id"], "left").fillna(0.0, ["total", "squares", "max_value"])
    mean = F.col("total") / F.col("n_cells")
    var = F.when(F.col("n_cells") > 1, F.greatest((F.col("squares") - F.col("n_cells") * mean * mean) / (F.col("n_cells") - 1), F.lit(0.0))).otherwise(0.0)
    return out.withColumns({"mean": mean, "variance": var})


def variance_trend(moments: DataFrame, by: str | None, least: int = 20) -> DataFrame:
    """moments with reg_std: the root of the variance that a parabola of log10 variance over log10 mean gives, in each group.

    The parabola is fitted to the features that vary, of which a group must have `least`, else the query fails; constant
    ones keep reg_std 1. Its sums are taken about the group's mean of x, which keeps the equations well conditioned.
    Without by, all moments are one group.
    """
    keys = [by] if by else ["_all"]
    p = moments if by else moments.withColumn("_all", F.lit("all features"))
    fit = (F.col("variance") > 0) & (F.col("mean") > 0)
    x, y = F.log10(F.greatest("mean", F.lit(1e-12))), F.log10(F.greatest("variance", F.lit(1e-12)))
    p = p.withColumns({"x": x, "y": y, "fit": fit})
    # one row for each group; a shuffle join, as groups may be many
    centre = p.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("fit"), F.col("x"))), F.lit(0.0)).alias("cx"))
    p = p.join(centre, keys).withColumn("u", F.col("x") - F.col("cx"))
    power = lambda e: F.sum(F.when(F.col("fit"), e))
    s = p.groupBy(*keys).agg(F.count_if("fit").alias("s0"), *(power(F.col("u") ** k).alias(f"s{k}") for k in range(1, 5)), *(power(F.col("y") * F.col("u") ** k).alias(f"t{k}") for k in range(3)))
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    base = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    enough = F.when(F.col("s0") < least, F.raise_error(F.concat(F.lit("too few features vary in "), F.col(keys[0]).cast("string"))).cast("double")).otherwise(base)
    coef = s.withColumn("base", enough).select(*keys, (det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / F.col("base")).alias("c0"), (det(s0, t0, s2, s1, t1, s3, s2, t2, s4) / F.col("base")).alias("c1"), (det(s0, s1, t0, s1, s2, t1, s2, s3, t2) / F.col("base")).alias("c2"))
    out = p.join(coef, keys)
    fitted = F.when(F.col("fit"), F.col("c0") + F.col("c1") * F.col("u") + F.col("c2") * F.col("u") ** 2).otherwise(0.0)
    return out.withColumn("reg_std", F.sqrt(F.pow(F.lit(10.0), fitted))).drop("x", "y", "u", "cx", "fit", "c0", "c1", "c2", "_all")


def normalised_variance(obs: DataFrame, counts: DataFrame, by: str | None = None) -> DataFrame:
    """Variance of clipped, standardised values of every feature, in each group or over all observations.

    Values meet the clips of their group and feature by a join that Spark broadcasts only where its own figures allow it.
    """
    keys = [by] if by else []
    trend = variance_trend(feature_moments(obs, counts, by), by)
    trend = trend.withColumn("clip", F.col("reg_std") * F.sqrt("n_cells") + F.col("mean"))
    rows = valid_values(counts).join(obs.select("obs_id", *keys), "obs_id").join(trend.select(*keys, "feature_id", "clip"), [*keys, "feature_id"])
    v = F.least("value", "clip")
    sums = rows.groupBy(*keys, "feature_id").agg(F.sum(v).alias("c1"), F.sum(v * v).alias("c2"))
    out = trend.join(sums, [*keys, "feature_id"], "left").fillna(0.0, ["c1", "c2"])
    n, m = F.col("n_cells"), F.col("mean")
    return out.withColumn("norm_var", (n * m * m + F.col("c2") - 2 * m * F.col("c1")) / ((n - 1) * F.col("reg_std") ** 2))


def select_variable(obs: DataFrame, counts: DataFrame, n_top: int = 2000, by: str | None = "population") -> DataFrame:
    """The n_top features by the median of their ranks in the groups where they are among the n_top; ties go to more groups,
    then the lesser id. Without by, all observations are one group and the rank in it counts."""
    nv = normalised_variance(obs, counts, by)
    order = (F.col("norm_var").desc(), "feature_id")
    if by is None:
        best = nv.select("feature_id", "norm_var").orderBy(*order).limit(n_top)  # n_top rows
        rank = F.row_number().over(W.orderBy(*order)).cast("double")
        return best.select("feature_id", rank.alias("median_rank"), F.lit(1).cast("long").alias("n_groups")).orderBy("median_rank")
    top = nv.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n_top)
    best = top.groupBy("feature_id").agg(F.median("rank").alias("median_rank"), F.count("*").alias("n_groups"))
    return best.orderBy("median_rank", F.col("n_groups").desc(), "feature_id").limit(n_top)


def placed(top: DataFrame) -> DataFrame:
    """place (from 0), feature_id of the rows that `select_variable` gives, in their order; as many rows as are selected."""
    order = W.orderBy("median_rank", F.col("n_groups").desc(), "feature_id")
    return top.select((F.row_number().over(order) - 1).cast("long").alias("place"), "feature_id")


def library_size(obs: DataFrame, counts: DataFrame) -> DataFrame:
    """obs with total, the sum of the valid values of each observation; 0 without any."""
    sums = valid_values(counts).groupBy("obs_id").agg(F.sum("value").alias("total"))
    return obs.join(sums, "obs_id", "left").fillna(0.0, ["total"])


def log_normalise(counts: DataFrame, target: float = 10000.0) -> DataFrame:
    """obs_id, feature_id, value = log1p(count * target / total of the observation)."""
    valid = valid_values(counts)
    total = F.sum("value").over(W.partitionBy("obs_id"))
    return valid.select("obs_id", "feature_id", F.log1p(F.col("value") * target / total).alias("value"))


def padded_tokens(tokens: DataFrame, length: int, pad_id: int = 0, start: tuple[int, float] | None = None) -> DataFrame:
    """obs_id, features, values: the tokens of each observation (obs_id, feature_id, position, value) in order as arrays of one
    length, filled up with pad_id and 0.

    start, if given, is a feature and value that every row begins with; it takes one of the places. Tokens beyond the length
    are left out. Observations without tokens have no row.
    """
    held = tokens.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("feature_id").cast("int").alias("f"), F.col("value").cast("double").alias("v")))).alias("e"))
    head = F.array(F.struct(F.lit(start[0]).alias("f"), F.lit(float(start[1])).alias("v"))) if start else F.array().cast("array<struct<f:int,v:double>>")
    body = F.concat(head, F.transform("e", lambda e: F.struct(e["f"].alias("f"), e["v"].alias("v"))))
    fill = F.array_repeat(F.struct(F.lit(pad_id).alias("f"), F.lit(0.0).alias("v")), length)
    row = held.select("obs_id", F.slice(F.concat(body, fill), 1, length).alias("e"))
    return row.select("obs_id", F.col("e.f").alias("features"), F.col("e.v").alias("values"))


def feature_tokens(normal: DataFrame, k: int) -> DataFrame:
    """The k features of each observation with the greatest values; position, and weight in percent of the k."""
    order = W.partitionBy("obs_id").orderBy(F.col("value").desc(), "feature_id")
    top = normal.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return top.withColumn("weight", 100 * F.col("value") / F.sum("value").over(W.partitionBy("obs_id")))


def group_means(obs: DataFrame, values: DataFrame, keys) -> DataFrame:
    """Mean of each feature over all observations of a group, zeros included; features absent from a group are left out."""
    sizes = obs.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    sums = values.join(obs.select("obs_id", *keys), "obs_id").groupBy(*keys, "feature_id").agg(F.sum("value").alias("total"))
    return sums.join(sizes, list(keys)).select(*keys, "feature_id", "n_cells", (F.col("total") / F.col("n_cells")).alias("mean"))


def group_moments(obs: DataFrame, values: DataFrame, keys) -> DataFrame:
    """n_cells, mean and unbiased variance (0 for one observation) per group and feature of the vocabulary, zeros included."""
    sizes = obs.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    vocabulary = values.select("feature_id").distinct()
    sums = values.join(obs.select("obs_id", *keys), "obs_id").groupBy(*keys, "feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    out = sizes.join(F.broadcast(vocabulary)).join(sums, [*keys, "feature_id"], "left").fillna(0.0, ["s", "q"])
    n, mean = F.col("n_cells"), F.col("s") / F.col("n_cells")
    return out.select(*keys, "feature_id", "n_cells", mean.alias("mean"), F.when(n > 1, F.greatest((F.col("q") - n * mean * mean) / (n - 1), F.lit(0.0))).otherwise(0.0).alias("variance"))


def expression_bins(values: DataFrame, bins: int) -> DataFrame:
    """place, boundary: 0 and then bins - 2 quantiles of the positive values, evenly spaced from the least to the greatest.

    Quantiles are exact, so values should be those of a sample of bounded size, as `even_sample` gives it.
    """
    if bins < 4:
        raise ValueError("4 bins or more")
    at = [i / (bins - 3) for i in range(bins - 2)]
    cuts = values.where("value > 0").agg(F.percentile("value", F.array(*map(F.lit, at))).alias("q")).where("q is not null")
    return cuts.select(F.posexplode(F.concat(F.array(F.lit(0.0)), "q")).alias("place", "boundary"))


def first_components(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """vectors (an array column) with pc1 and pc2, the coordinates on the two directions of greatest variance, centred.

    Each direction points to where its largest weight is positive. Only the covariance, of the width squared, and the
    directions are held at once. Null vectors are left out.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    held = vectors.where(F.col(column).isNotNull()).withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    pc = PCA(k=2, inputCol="_v", outputCol="_pc").fit(held).pc.toArray().copy()
    for k in range(2):
        if pc[abs(pc[:, k]).argmax(), k] < 0:
            pc[:, k] *= -1
    dot = lambda k: F.aggregate(F.zip_with(F.col(column).cast("array<double>"), F.array(*(F.lit(float(x)) for x in pc[:, k])), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    raw = held.drop("_v").withColumns({"pc1": dot(0), "pc2": dot(1)})
    mean = raw.agg(F.avg("pc1").alias("_m1"), F.avg("pc2").alias("_m2"))
    return raw.join(F.broadcast(mean)).withColumns({"pc1": F.col("pc1") - F.col("_m1"), "pc2": F.col("pc2") - F.col("_m2")}).drop("_m1", "_m2")
