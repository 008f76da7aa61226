"""Distances between predicted and observed vectors, rankings of differential features, covariances, rollups."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.operators.blocks import BLOCK, dense, vectors
from obsidia.operators.census import CONDITION


def wasserstein(rows: DataFrame, keys=CONDITION) -> DataFrame:
    """Mean distance between the sorted predicted and the sorted observed values of each group."""
    by = W.partitionBy(*keys)
    side = lambda c: rows.select(*keys, c, F.row_number().over(by.orderBy(c)).alias("place"))
    joined = side("predicted").join(side("observed"), [*keys, "place"])
    return joined.groupBy(*keys).agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("wasserstein"))


#: Bins of a histogram, share of the median cost that blurs the plan, and turns of the scaling.
BINS, BLUR, TURNS = 64, 0.05, 60


def _scaled(batches, names):
    """Entropic transport between the histograms p and o of many groups at once, by alternate scaling of rows and columns."""
    apart = np.square(np.arange(BINS)[:, None] - np.arange(BINS)[None]).astype(np.float64)
    typical = np.median(apart[apart > 0])
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            p, o = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, BINS) for c in "po")
            square = np.square(part.column("width").to_numpy(zero_copy_only=False))[:, None, None]
            cost = apart[None] * square
            kernel = np.exp(-cost / np.maximum(BLUR * typical * square, 1e-8))
            left, right = np.ones_like(p), np.ones_like(o)
            for _ in range(TURNS):
                left = p / np.maximum((kernel @ right[:, :, None])[:, :, 0], 1e-30)
                right = o / np.maximum((kernel @ left[:, :, None])[:, :, 0], 1e-30)
            total = ((left[:, :, None] * kernel * right[:, None]) * cost).sum(axis=(1, 2))
            yield pa.record_batch([*(part.column(n) for n in names), pa.array(np.sqrt(np.maximum(total, 0)))], names=[*names, "sinkhorn"])


def sinkhorn(rows: DataFrame, keys=CONDITION) -> DataFrame:
    """keys, sinkhorn: entropic transport distance between the histograms of predicted and observed values of each group.

    Histograms of BINS equal bins from the least to the greatest value are counted by Spark; BINS numbers of each side reach
    Python, many groups at a time. Null where any value is null, NaN or infinite; 0 where all values are equal.
    """
    keys = list(keys)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    lim = rows.groupBy(*keys).agg(F.min(F.least("predicted", "observed")).alias("lo"), F.max(F.greatest("predicted", "observed")).alias("hi"), F.bool_and(finite("predicted") & finite("observed")).alias("fit"), F.count("*").alias("n"))
    named = lim.select(*(F.col(k).alias(f"_{k}") for k in keys), "lo", "hi", "n", (F.col("fit") & (F.col("hi") - F.col("lo") >= 1e-12)).alias("spread"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = rows.join(named.where("spread"), same)
    place = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
    sides = F.explode(F.array(*(F.struct(place(c).alias("bin"), F.lit(float(c == "predicted")).alias("p"), F.lit(float(c == "observed")).alias("o")) for c in ("predicted", "observed")))).alias("e")
    counted = placed.select(*keys, "lo", "hi", "n", sides).groupBy(*keys, "lo", "hi", "n", "e.bin").agg(*(F.sum(f"e.{c}").alias(c) for c in "po"))
    filled = counted.groupBy(*keys, "lo", "hi", "n").agg(*(F.map_from_entries(F.collect_list(F.struct("bin", c))).alias(c) for c in "po"))
    spread = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.element_at(c, i), F.lit(0.0)) / F.col("n"))
    hist = filled.select(*keys, spread("p").alias("p"), spread("o").alias("o"), ((F.col("hi") - F.col("lo")) / BINS).alias("width"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    done = hist.mapInArrow(lambda it: _scaled(it, keys), f"{kinds}, sinkhorn double")
    flat = lim.where(~F.col("fit") | (F.col("hi") - F.col("lo") < 1e-12)).select(*keys, F.when(F.col("fit"), 0.0).alias("sinkhorn"))
    return done.unionByName(flat)


def _median_gap(v: np.ndarray) -> float:
    """Median of the positive distances |v[i] - v[j]| over ordered pairs of sorted values; 0 if there is none."""
    equal = np.searchsorted(v, v, "right") - np.searchsorted(v, v, "left")
    n = (len(v) ** 2 - int(equal.sum())) // 2  # each positive distance stands in two ordered pairs
    if not n:
        return 0.0
    upper = np.searchsorted(v, v, "right")  # the first place that lies above

    def at(rank):
        """The distance of that rank, from 1, by halving the bits of the distance."""
        lo, hi = 0, int(np.float64(v[-1] - v[0]).view(np.int64))
        while lo < hi:
            mid = (lo + hi) // 2
            gap = np.int64(mid).view(np.float64)
            reach = np.searchsorted(v, v + gap, "right")
            # v + gap is rounded: settle the places beside it by the distance itself
            while (more := (reach < len(v)) & (v[np.minimum(reach, len(v) - 1)] - v <= gap)).any():
                reach = reach + more
            while (less := (reach > upper) & (v[np.maximum(reach - 1, 0)] - v > gap)).any():
                reach = reach - less
            if int(np.maximum(reach - upper, 0).sum()) >= rank:
                hi = mid
            else:
                lo = mid + 1
        return float(np.int64(lo).view(np.float64))

    # over ordered pairs there are 2 n distances, each twice: the median is the mean of the ranks n / 2 and n / 2 + 1 of n
    return at((n + 1) // 2) if n % 2 else (at(n // 2) + at(n // 2 + 1)) / 2


def _mmd(predicted, observed, most):
    sides = []
    for v in (predicted, observed):
        v = np.sort(np.asarray(v, dtype=np.float64))
        sides.append(v if len(v) <= most else v[np.linspace(0, len(v) - 1, most).astype(np.int64)])
    width = _median_gap(np.sort(np.concatenate(sides)))
    if not width:
        return 0.0
    scale = 2 * max(width, 1e-8) ** 2
    # a row of the kernel at a time: memory is linear in the group
    mean = lambda a, b: sum(float(np.exp(-np.square(x - b) / scale).sum()) for x in a) / len(a) / len(b)
    p, o = sides
    return float(np.sqrt(max(mean(p, p) + mean(o, o) - 2 * mean(p, o), 0.0)))


def _discrepancies(batches, names, most):
    for batch in batches:
        found = []
        for p, o, fit in zip(batch.column("p"), batch.column("o"), batch.column("fit").to_pylist()):
            found.append(_mmd(p.values.to_numpy(zero_copy_only=False), o.values.to_numpy(zero_copy_only=False), most) if fit else None)
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(found, pa.float64())], names=[*names, "mmd"])


def mmd_rbf(rows: DataFrame, keys=CONDITION, most: int = 512) -> DataFrame:
    """keys, mmd: maximum mean discrepancy of predicted and observed values with a Gaussian kernel as wide as the median
    positive distance.

    A side keeps at most `most` evenly spaced order statistics. The median is searched for over sorted values and the kernel
    summed a row at a time, so a group takes memory for its values alone. Null where a value is null, NaN or infinite; 0 if
    all are equal.
    """
    keys = list(keys)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    arrays = rows.groupBy(*keys).agg(F.collect_list("predicted").alias("p"), F.collect_list("observed").alias("o"), F.bool_and(finite("predicted") & finite("observed")).alias("fit"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return arrays.mapInArrow(lambda it: _discrepancies(it, keys, most), f"{kinds}, mmd double")


def deg_ranking(rows: DataFrame, marks: DataFrame, top_k: int, keys=CONDITION) -> DataFrame:
    """How well the size of the predicted difference from control ranks the marked features (keys, feature_id).

    deg_auroc: area under the curve of steps, each feature its own step; deg_auprc: mean precision at the marked ones;
    both null if all or none are marked, or a predicted difference is null, NaN or infinite. deg_overlap: share of the top_k
    marked features by observed difference among the top_k of all by predicted difference. Sizes are compared as they are;
    ties go to the lesser feature.
    """
    marked = rows.join(marks.select(*keys, "feature_id").distinct().withColumn("hit", F.lit(1)), [*keys, "feature_id"], "left").fillna(0, ["hit"])
    size = lambda c: F.abs(F.col(c) - F.col("control"))
    by = W.partitionBy(*keys)
    order = by.orderBy(size("predicted").desc(), "feature_id")
    ranked = marked.select(
        *keys, "hit", F.coalesce(size("predicted") < float("inf"), F.lit(False)).alias("finite"),
        F.row_number().over(order).alias("place"),
        F.sum("hit").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("above"),
        F.row_number().over(by.orderBy(F.col("hit").desc(), size("observed").desc(), "feature_id")).alias("true_place"),
    )
    hit = F.col("hit") == 1
    sums = ranked.groupBy(*keys).agg(
        F.sum("hit").alias("pos"), F.count_if(~hit).alias("neg"), F.sum(F.when(~hit, F.col("above"))).alias("area"),
        F.sum(F.when(hit, F.col("above") / F.col("place"))).alias("precision"),
        F.count_if(hit & (F.col("place") <= top_k) & (F.col("true_place") <= top_k)).alias("both"), F.bool_and("finite").alias("finite"),
    )
    mixed = F.col("finite") & (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(
        *keys,
        F.when(mixed, F.col("area") / (F.col("pos") * F.col("neg"))).alias("deg_auroc"),
        F.when(mixed, F.col("precision") / F.col("pos")).alias("deg_auprc"),
        (F.col("both") / F.greatest(F.least("pos", F.lit(top_k)), F.lit(1))).alias("deg_overlap"),
    )


def covariance_score(rows: DataFrame, keys=CONDITION, block: int = BLOCK) -> DataFrame:
    """One row, css: Frobenius norm of the difference of the covariances between features of predicted and of observed
    differences from control, over that of the observed ones. Null with fewer than two conditions.

    The norms come from the inner products of the centred vectors of all pairs of conditions, a pair of blocks in a task;
    neither pairs of conditions nor of features are rows. A feature that a condition lacks counts as the feature's mean,
    null values likewise.
    """
    d = rows.select(*keys, "feature_id", (F.col("predicted") - F.col("control")).alias("p"), (F.col("observed") - F.col("control")).alias("o"))
    mean = d.groupBy("feature_id").agg(F.avg("p").alias("mp"), F.avg("o").alias("mo"))
    centred = d.join(mean, "feature_id").select(*keys, "feature_id", *(F.coalesce(F.col(c) - F.col(f"m{c}"), F.lit(0.0)).alias(c) for c in "po"))
    n = d.select(*keys).distinct().agg(F.count("*").alias("n"))
    v = vectors(centred, keys, ["p", "o"]).join(n.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    v = v.withColumn("own", F.pmod(F.xxhash64(*keys), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    v = v.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "feature", "p", "o")

    def products(part: pa.Table) -> pa.Table:
        p, o = dense(part, ["p", "o"], 0.0)
        own = part.column("own").to_numpy()
        x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
        a, b = own == x, own == y
        squares = lambda u, w: float(((u @ w.T) ** 2).sum())
        both, seen, mixed = squares(p[a], p[b]), squares(o[a], o[b]), squares(p[a], o[b])
        if x != y:
            both, seen, mixed = 2 * both, 2 * seen, mixed + squares(o[a], p[b])
        return pa.table({"off": [both + seen - 2 * mixed], "base": [seen]})

    sums = v.groupBy("x", "y").applyInArrow(products, "off double, base double").agg(F.sum("off").alias("off"), F.sum("base").alias("base"))
    scale = F.col("n") - 1
    score = F.sqrt(F.greatest("off", F.lit(0.0))) / scale / F.greatest(F.sqrt("base") / scale, F.lit(1e-12))
    return sums.join(n).select(F.when(F.col("n") > 1, score).alias("css"))


def rollup_means(rows: DataFrame, key: str, run: str, metrics, overall: str | None = None) -> DataFrame:
    """Means of metrics by key, finite values only, and the number of runs; with `overall`, a row of that name holds the
    means of the means."""
    finite = lambda c: F.avg(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))).alias(c)
    means = rows.groupBy(key).agg(*map(finite, metrics), F.count_distinct(run).alias("n_runs"))
    if overall is None:
        return means
    return means.unionByName(means.agg(F.lit(overall).alias(key), *(F.avg(c).alias(c) for c in metrics), F.max("n_runs").alias("n_runs")))
