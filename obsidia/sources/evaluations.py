"""Evaluation documents, one JSON object a file, as tables of metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a document. The last three hold objects of open schema and are kept as text.
TEXTS = ("model", "regime", "evaluation_split", "split_id", "split_file", "checkpoint", "checkpoint_sha256")
SUMMARIES = ("summary", "dose_level", "cell_line_drug")
#: Names of the units which the three summaries are about.
UNITS = ("primary", "dose_level_condition", "cell_line_drug")


def read_documents(spark: SparkSession, paths: str | list[str], pattern: str = "*.json", default_model: str | None = None) -> DataFrame:
    """path, folder and above (the names of the two folders over a file), TEXTS and SUMMARIES of each document.

    paths are files or folders, searched through; files that begin with _ or . don't count. Members that a document lacks
    are null, but a missing model is default_model. A file that is no JSON object fails the query that reads it.
    """
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    files = files.select("value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"))
    schema = ", ".join(f"{c} string" for c in (*TEXTS, *SUMMARIES))
    read = F.from_json("value", schema, {"mode": "FAILFAST"})
    steps = F.split("path", "/")
    rows = files.select("path", F.try_element_at(steps, F.lit(-2)).alias("folder"), F.try_element_at(steps, F.lit(-3)).alias("above"), read.alias("d"))
    return rows.select("path", "folder", "above", F.coalesce("d.model", F.lit(default_model)).alias("model"), *(F.col(f"d.{c}").alias(c) for c in (*TEXTS[1:], *SUMMARIES)))


def _members(text) -> F.Column:
    return F.from_json(text, "map<string,string>")


def collect_evaluations(documents: DataFrame, regimes: list[str] | None = None) -> DataFrame:
    """evaluation_id, evaluation_file, TEXTS, evaluation_unit, metric, statistics (name -> number), value: a row for each metric of
    each of a document's three summaries.

    A metric that is an object has statistics, any other a value, null if it is no number. evaluation_id is the name of the
    folder two above the file and the split, or of the file's folder where no split is named. regimes, if given, are the ones
    wanted. Summaries that are missing or empty give no rows.
    """
    rows = documents if regimes is None else documents.where(F.col("regime").isin(list(regimes)))
    split = F.col("evaluation_split")
    name = F.when(split.isNotNull() & (split != ""), F.concat("above", F.lit(":"), split)).otherwise(F.col("folder"))
    nested = [F.col(SUMMARIES[0]), *(F.get_json_object(c, "$.summary") for c in SUMMARIES[1:])]
    each = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), n.alias("text")) for u, n in zip(UNITS, nested)))).alias("s")
    units = rows.select(name.alias("evaluation_id"), F.col("path").alias("evaluation_file"), *TEXTS, each)
    metrics = units.select("evaluation_id", "evaluation_file", *TEXTS, F.col("s.unit").alias("evaluation_unit"), F.explode(_members("s.text")).alias("metric", "text"))
    is_object = F.startswith(F.ltrim("text"), F.lit("{"))
    return metrics.select(
        "evaluation_id", "evaluation_file", *TEXTS, "evaluation_unit", "metric",
        F.when(is_object, F.from_json("text", "map<string,double>")).alias("statistics"), F.when(~is_object, F.col("text").try_cast("double")).alias("value"),
    )


def generalization_summary(documents: DataFrame) -> DataFrame:
    """evaluation_id (the file's folder), model, regime, split_id, checkpoint, path and summary (metric -> JSON text; empty if
    missing) of each document."""
    empty = F.create_map().cast("map<string,string>")
    return documents.select(F.col("folder").alias("evaluation_id"), "model", "regime", "split_id", "checkpoint", "path", F.coalesce(_members("summary"), empty).alias("summary"))
