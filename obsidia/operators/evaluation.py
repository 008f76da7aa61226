"""Evaluation of predicted conditions in full: all metrics of a condition, summaries over conditions, and exported arrays."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.operators import distances, responses
from obsidia.operators.census import CONDITION
from obsidia.operators.summaries import correlation, finite

METRICS = ("r2", "pearson", "pearson_delta", "direction_accuracy", "mse", "wasserstein", "mmd", "sinkhorn")
DEG_METRICS = ("deg_auroc", "deg_auprc", "deg_overlap")


def _beside(parts: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    """keys and names of tables that have each some of names for a group of keys: laid below each other and gathered by keys,
    so that null keys meet and the plan has no chain of joins."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*(F.max(c).alias(c) for c in names))


def all_metrics(rows: DataFrame, features: DataFrame | None = None, marks: DataFrame | None = None, top_k: int = 50, keys=CONDITION) -> DataFrame:
    """keys and METRICS of each condition, over the given features (feature_id) or all; with marks (keys, feature_id) also
    DEG_METRICS, which rank all features, and n_marks, how many features are marked.

    rows: keys, feature_id, predicted, observed, control. A condition without any of the given features has no metric; one without
    marks has null deg_auroc and deg_auprc.
    """
    keys = list(keys)
    part = rows if features is None else rows.join(features.select("feature_id").distinct(), "feature_id", "left_semi")
    base = responses.condition_metrics(part, keys).withColumn("_there", F.lit(1))
    parts = [base, distances.wasserstein(part, keys), distances.mmd_rbf(part, keys), distances.sinkhorn(part, keys)]
    names = list(METRICS)
    if marks is not None:
        n = rows.select(*keys, "feature_id").join(marks.select(*keys, "feature_id").distinct(), [*keys, "feature_id"], "left_semi").groupBy(*keys).agg(F.count("*").alias("n_marks"))
        parts += [distances.deg_ranking(rows, marks, top_k, keys), n]
        names += [*DEG_METRICS, "n_marks"]
    held = _beside(parts, keys, [*names, "_there"]).where("_there = 1").drop("_there")
    return held.fillna(0, ["n_marks"]) if marks is not None else held


def biological_score(rows: DataFrame) -> DataFrame:
    """One row: mean_pearson (of the populations that have one), mean_direction, magnitude_pearson (between the populations'
    mean sizes of predicted and observed differences) and score, the mean of those that are not null."""
    by = responses.biological(rows)
    size = correlation("predicted_size", "observed_size")
    one = by.agg(F.avg(finite("pearson")).alias("mean_pearson"), F.avg("direction").alias("mean_direction"), size.alias("magnitude_pearson"))
    parts = F.array_compact(F.array("mean_pearson", "mean_direction", "magnitude_pearson"))
    return one.withColumn("score", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts)))


def full_summary(rows: DataFrame, records: DataFrame, metrics, top_k: int | None = None) -> DataFrame:
    """One row over all conditions: n_conditions, the means of the finite values of metrics (columns of records, a row for each
    condition), n_few_marks (conditions of fewer than top_k marked features, where records have n_marks), pds and pds_euclidean
    (means over populations of the city-block and Euclidean scores), both over all conditions (pds_global,
    pds_euclidean_global), disentanglement of the predicted differences, css, and the parts of `biological_score`.

    Each part is one row; none depends on how many conditions there are. Without conditions all but n_conditions are null.
    """
    few = [F.count_if(F.coalesce("n_marks", F.lit(0)) < top_k).alias("n_few_marks")] if top_k is not None else []
    parts = [records.agg(F.count("*").alias("n_conditions"), *(F.avg(finite(m)).alias(m) for m in metrics), *few)]
    for name, distance in (("pds", "cityblock"), ("pds_euclidean", "euclidean")):
        parts.append(responses.discrimination(rows, distance).agg(F.avg("pds").alias(name)))
        parts.append(responses.discrimination(rows, distance, overall=True).agg(F.max("pds").alias(f"{name}_global")))
    parts += [responses.disentanglement(rows, "predicted"), distances.covariance_score(rows), biological_score(rows)]
    return _beside(parts, [], [c for part in parts for c in part.columns])


def exported(rows: DataFrame, keys=CONDITION) -> DataFrame:
    """A row for each condition with the arrays predicted, observed and control in the order of feature_id."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature_id", "predicted", "observed", "control"))).alias("v"))
    return held.select(*keys, F.col("v.feature_id").alias("features"), *(F.col(f"v.{c}").alias(c) for c in ("predicted", "observed", "control")))


def analyze_predictions(rows: DataFrame) -> DataFrame:
    """rows (arrays predicted, observed and control of one length beside any other columns) without the arrays, with r2,
    pcc_logfc, mse and direction_accuracy, each within its row.

    r2 is null where the observed values do not vary, pcc_logfc where either difference from control does not; all are null
    for empty arrays. Differences are centred before they are multiplied.
    """
    arrays = ("predicted", "observed", "control")
    z = rows.withColumn("_z", F.arrays_zip(*arrays))
    n = F.size("_z")
    mean = lambda f: F.when(n > 0, F.aggregate("_z", F.lit(0.0), lambda s, e: s + f(e)) / n)
    p, o = (lambda e: e["predicted"].cast("double") - e["control"].cast("double")), (lambda e: e["observed"].cast("double") - e["control"].cast("double"))
    centred = z.withColumns({"_o": mean(lambda e: e["observed"].cast("double")), "_dp": mean(p), "_do": mean(o)})
    sums = centred.withColumns({
        "mse": mean(lambda e: (e["predicted"].cast("double") - e["observed"]) ** 2), "_v": mean(lambda e: (e["observed"].cast("double") - F.col("_o")) ** 2),
        "_pp": mean(lambda e: (p(e) - F.col("_dp")) ** 2), "_oo": mean(lambda e: (o(e) - F.col("_do")) ** 2), "_po": mean(lambda e: (p(e) - F.col("_dp")) * (o(e) - F.col("_do"))),
        "direction_accuracy": mean(lambda e: (F.signum(p(e)) == F.signum(o(e))).cast("double")),
    })
    r2 = F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v"))
    pcc = F.when((F.col("_pp") > 0) & (F.col("_oo") > 0), F.col("_po") / F.sqrt(F.col("_pp") * F.col("_oo")))
    return sums.select(*(c for c in rows.columns if c not in arrays), r2.alias("r2"), pcc.alias("pcc_logfc"), "mse", "direction_accuracy")


def _by_size(delta: str) -> F.Column:
    """Places of an array's elements by their size, the largest first, equal ones in order."""
    return F.transform(F.array_sort(F.transform(delta, lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i")))), lambda e: e["i"])


def analyze_degs(rows: DataFrame, top_k: list[int] | tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """rows (arrays predicted, observed, control and, if there, true_deg_ids, places from 0 in order of importance) without the
    arrays, with top_k, overlap, direction_accuracy and deg_source, a row for each of top_k.

    The true places are the first k exported ones or, without any, the k of the largest observed difference from control;
    overlap is the share of them among the k of the largest predicted difference, direction_accuracy the share whose signs
    agree, null without any.
    """
    arrays = ("predicted", "observed", "control", "true_deg_ids")
    given = F.col("true_deg_ids").cast("array<int>") if "true_deg_ids" in rows.columns else F.lit(None).cast("array<int>")
    delta = lambda c: F.zip_with(c, "control", lambda a, b: a.cast("double") - b)
    held = rows.withColumns({"_p": delta("predicted"), "_o": delta("observed"), "_given": given}).withColumns({"_bp": _by_size("_p"), "_bo": _by_size("_o")})
    supplied = F.coalesce(F.size("_given") > 0, F.lit(False))
    each = held.withColumn("top_k", F.explode(F.array(*map(F.lit, top_k)))).withColumn("_true", F.when(supplied, F.expr("slice(_given, 1, top_k)")).otherwise(F.expr("slice(_bo, 1, top_k)")))
    both = F.size(F.array_intersect("_true", F.expr("slice(_bp, 1, top_k)")))
    agree = F.aggregate("_true", F.lit(0.0), lambda s, i: s + (F.signum(F.get("_p", i)) == F.signum(F.get("_o", i))).cast("double"))
    n = F.size("_true")
    return each.select(
        *(c for c in rows.columns if c not in arrays), "top_k", (both / F.greatest(F.size(F.array_distinct("_true")), F.lit(1))).alias("overlap"), F.when(n > 0, agree / n).alias("direction_accuracy"),
        F.when(supplied, "exported_true_deg_ids").otherwise("top_abs_observed_delta").alias("deg_source"),
    )


def deg_summary(degs: DataFrame) -> DataFrame:
    """top_k, mean_overlap, mean_direction_accuracy, of finite values."""
    return degs.groupBy("top_k").agg(F.avg(finite("overlap")).alias("mean_overlap"), F.avg(finite("direction_accuracy")).alias("mean_direction_accuracy"))


def _mean_delta() -> F.Column:
    return F.aggregate(F.zip_with("predicted", "control", lambda a, b: a.cast("double") - b), F.lit(0.0), lambda s, x: s + x) / F.size("predicted")


def dose_response(rows: DataFrame) -> DataFrame:
    """dose (0 if null), response: the mean predicted difference from control of each exported row, by dose."""
    return rows.select(F.coalesce("dose", F.lit(0.0)).alias("dose"), _mean_delta().alias("response")).orderBy("dose", "response")


def response_heatmap(rows: DataFrame, order: list[str], n_rows: int = 20, n_features: int = 40) -> DataFrame:
    """row, place, value: predicted differences from control of the first n_rows exported rows and n_features places, over the
    largest size among them; a picture of fixed size, whatever the table's."""
    first = rows.orderBy(*order).limit(n_rows).select(*order, F.slice(F.zip_with("predicted", "control", lambda a, b: a.cast("double") - b), 1, n_features).alias("d"))
    row = first.agg(F.array_sort(F.collect_list(F.struct(*order, "d"))).alias("rows")).select(F.posexplode("rows").alias("row", "r")).select("row", F.posexplode("r.d").alias("place", "d"))
    scale = row.agg(F.greatest(F.max(F.abs("d")), F.lit(1e-9)).alias("scale"))
    return row.crossJoin(F.broadcast(scale)).select("row", "place", (F.col("d") / F.col("scale")).alias("value"))


def response_scatter(rows: DataFrame, order: list[str], n_rows: int = 32, n_points: int = 40) -> DataFrame:
    """predicted, observed at every size/n_points-th place (at least each) of the first n_rows exported rows; fixed in size."""
    first = rows.orderBy(*order).limit(n_rows).select(F.posexplode(F.arrays_zip("predicted", "observed")).alias("place", "e"), F.greatest(F.lit(1), F.expr(f"size(predicted) div {n_points}")).alias("step"))
    return first.where("place % step = 0").select("e.predicted", "e.observed")
