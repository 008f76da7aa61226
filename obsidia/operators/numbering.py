"""Places and running sums within groups of any size, in two passes over range partitions."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsidia.sources.shared import checkpointed


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """rows with `place`, from 0 within keys in the given order, and with `total`, if named, the rows of the group.

    With weight, place is the sum of the weights before a row and total their sum. Rows are dealt by ranges of keys and
    order and computed once; the ranges' counts, a row for each range and group that meet, are summed up, and each range
    counts on from its own start. So a group is shared by as many tasks as it fills ranges. Null keys are a group, null
    weights count 0; equal values of order stand in any order, but the same in all that follows.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*keys, *order, "_tie"]
    laid = checkpointed(dealt.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    size = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count("*")
    sizes = laid.groupBy("_range", *keys).agg(size.alias("_size"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(W.partitionBy(*keys)).alias("_total"),
    )
    here = W.partitionBy("_range", *keys).orderBy(*order, "_tie")
    step = F.coalesce(F.sum(weight).over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(here) - 1
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = laid.withColumn("_step", step).join(starts, same)
    out = joined.withColumn(place, F.col("_start") + F.col("_step"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_tie", "_range", "_r", *(f"_k{i}" for i in range(len(keys))), "_start", "_total", "_step")
