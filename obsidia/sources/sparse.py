"""Long, wide and Matrix-Market tables as sparse rows: obs_id, features array<int> in order, values array<double>."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gather(long: DataFrame) -> DataFrame:
    """A sparse row for each obs_id of (obs_id, feature_id, value)."""
    rows = long.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("e"))
    return rows.select("obs_id", F.col("e.feature_id").alias("features"), F.col("e.value").alias("values"))


def long_to_sparse(long: DataFrame, selected: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Sparse rows of the selected obs_id, without excluded pairs (obs_id, feature_id).

    Null ids, features and values are left out, repeated pairs stay as they are. A selected observation without any row
    in `long` is an error; one whose pairs are all excluded has empty arrays.
    """
    ids = selected.select("obs_id").distinct()
    missing = ids.join(long.select("obs_id"), "obs_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"selected observations without rows, such as {missing.first()['obs_id']}")
    rows = long.where("feature_id is not null and value is not null").join(ids, "obs_id", "left_semi")
    if excluded is not None:
        rows = rows.join(excluded, ["obs_id", "feature_id"], "left_anti")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return ids.join(gather(rows), "obs_id", "left").select("obs_id", empty("features", "array<int>"), empty("values", "array<double>"))


def wide_to_sparse(wide: DataFrame, features: dict[str, int]) -> DataFrame:
    """Sparse rows of a table with obs_id and a column for each feature: values that are finite and positive."""
    columns = F.array(*(F.struct(F.lit(i).alias("feature_id"), F.col(f"`{c}`").cast("double").alias("value")) for c, i in sorted(features.items(), key=lambda kv: kv[1])))
    good = F.filter(columns, lambda e: (e["value"] > 0) & (e["value"] < float("inf")) & ~F.isnan(e["value"]))
    rows = wide.select("obs_id", good.alias("e"))
    return rows.select("obs_id", F.col("e.feature_id").alias("features"), F.col("e.value").alias("values"))


def coo_to_sparse(lines: DataFrame, n_observations: int) -> DataFrame:
    """Sparse rows from the text lines (`value`) of a Matrix-Market file; ids count from 0.

    Lines that begin with % are comments; the first other line has the sizes, which tell whether rows or columns are
    observations (columns, where both would do). Neither is an error.
    """
    numbers = lines.where("not startswith(trim(value), '%') and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    triplets = numbers.select(F.col("p")[0].cast("long").alias("r"), F.col("p")[1].cast("long").alias("c"), F.col("p")[2].cast("double").alias("v"))
    # the size line has the greatest row and column numbers that a file can hold, and the number of entries in place of a value
    size = triplets.agg(F.max("r").alias("r"), F.max("c").alias("c"), F.count("*").alias("n")).first()
    if size["n"] == 0 or n_observations not in (size["r"], size["c"]):
        raise ValueError(f"no side of the matrix has {n_observations} observations")
    obs, feature = ("c", "r") if size["c"] == n_observations else ("r", "c")
    header = (F.col("r") == size["r"]) & (F.col("c") == size["c"]) & (F.col("v") == size["n"] - 1)
    # an entry in the last row and column may equal the size line: one of the two goes
    flagged = triplets.withColumn("header", header)
    corner = flagged.where("header").limit(max(0, flagged.where("header").count() - 1)).drop("header")
    rows = flagged.where("not header").drop("header").unionByName(corner)
    return gather(rows.select((F.col(obs) - 1).alias("obs_id"), (F.col(feature) - 1).cast("int").alias("feature_id"), F.col("v").alias("value")))


def read_matrix_market(spark: SparkSession, path: str, n_observations: int) -> DataFrame:
    return coo_to_sparse(spark.read.text(path), n_observations)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet, CSV, tab-separated (.tsv, .txt) or JSON-lines table by its suffix, gzipped or not; a missing column is an error."""
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1]
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv", "txt"):
        df = spark.read.csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind in ("json", "jsonl"):
        df = spark.read.json(path)
    else:
        raise ValueError(f"unknown kind of table: {path}")
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.select(*columns) if columns else df


def expression_membership(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """The metadata of observations that have rows; rows without metadata are an error."""
    ids = rows.select("obs_id").distinct()
    lost = ids.join(metadata, "obs_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"rows without metadata, such as {lost.first()['obs_id']}")
    return metadata.join(ids, "obs_id", "left_semi")
