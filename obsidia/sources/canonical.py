"""The canonical source: a folder with sized Parquet files of observations, and tables of their samples and features.

data/ holds genes (array of token ids), expressions (array of the same length), cell_line_id, sample, drug, canonical_smiles
and plate; metadata/gene_metadata.parquet token_id and gene_symbol; metadata/sample_metadata.parquet sample, drug and
drugname_drugconc.
"""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from obsidia.functions.text import parse_treatment

#: Drug of a control, and columns of the tables.
CONTROL_DRUG = "DMSO_TF"
CELLS = ("genes", "expressions", "cell_line_id", "sample", "drug", "canonical_smiles", "plate")
TOKEN_COLUMNS, SYMBOL_COLUMNS = ("token_id", "gene_id"), ("gene_symbol", "gene_name")
ROWS_PER_FILE = 20_000


def sample_id() -> F.Column:
    """One id for all controls of a population and group, and one for each condition, of normalised metadata."""
    condition = F.to_json(F.array("population", "drug", F.col("dose").cast("string"), "dose_unit", "canonical_smiles"))
    return F.when(F.col("control"), F.concat_ws("::", F.lit("control"), "population", "matching_group")).otherwise(F.concat(F.lit("condition::"), condition))


def obs_to_canonical(metadata: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical observations, and the table of their samples (a row each).

    metadata: as `normalise_metadata` gives it, checked; rows: obs_id (the metadata's cell_id), features, values. Observations
    without a row have empty arrays, rows without metadata are left out. Controls get CONTROL_DRUG, dose 0 and no structure.
    A treated observation without a structure fails the query.
    """
    needed = F.when(F.col("control") | (F.col("canonical_smiles") != ""), F.col("canonical_smiles"))
    smiles = F.when(F.col("control"), F.lit("")).otherwise(F.coalesce(needed, F.raise_error(F.concat(F.lit("no structure of "), "drug")).cast("string")))
    named = metadata.withColumns({"sample": sample_id(), "smiles": smiles, "name": F.when(F.col("control"), CONTROL_DRUG).otherwise(F.col("drug"))})
    held = named.join(rows.select(F.col("obs_id").cast("string").alias("cell_id"), "features", "values"), "cell_id", "left")
    cells = held.select(
        F.coalesce("features", F.array().cast("array<int>")).alias("genes"), F.coalesce("values", F.array().cast("array<double>")).alias("expressions"),
        F.col("population").alias("cell_line_id"), "sample", F.col("name").alias("drug"), F.col("smiles").alias("canonical_smiles"), F.col("matching_group").alias("plate"),
    )
    text = F.format_string("[('%s', %s, '%s')]", "name", F.when(F.col("control"), 0.0).otherwise(F.col("dose")).cast("string"), "dose_unit")
    samples = named.select("sample", F.col("name").alias("drug"), text.alias("drugname_drugconc")).groupBy("sample").agg(F.min("drug").alias("drug"), F.min("drugname_drugconc").alias("drugname_drugconc"))
    return cells, samples


def write_canonical(cells: DataFrame, samples: DataFrame, features: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> dict[str, int]:
    """Writes the three tables under a new folder, no file of cells larger than rows_per_file; features: token_id, gene_symbol.

    Gives the figures that were taken while the cells were written: n_cells, n_controls, n_values, n_empty. A table that
    exists already is an error; Spark marks each with _SUCCESS when it is whole.
    """
    figures = Observation("canonical")
    seen = cells.select(*CELLS).observe(
        figures, F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("drug") == CONTROL_DRUG).alias("n_controls"),
        F.coalesce(F.sum(F.size("genes").cast("long")), F.lit(0)).alias("n_values"), F.count_if(F.size("genes") == 0).alias("n_empty"),
    )
    seen.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{path}/data")
    samples.select("sample", "drug", "drugname_drugconc").write.option("compression", "zstd").parquet(f"{path}/metadata/sample_metadata.parquet")
    features.select("token_id", "gene_symbol").write.option("compression", "zstd").parquet(f"{path}/metadata/gene_metadata.parquet")
    return figures.get


def _wanted(df: DataFrame, names) -> str:
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")
    return found


def scan_cells(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The wanted columns (default: all of CELLS) of the observations under path/data; a missing one is an error."""
    df = spark.read.parquet(f"{path}/data")
    columns = list(CELLS) if columns is None else columns
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.select(*columns)


def scan_sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The table of samples with treatment, struct(drug, dose, unit) of drugname_drugconc; rows without a sample are left out."""
    df = spark.read.parquet(f"{path}/metadata/sample_metadata.parquet").where("sample is not null")
    return df.withColumn("treatment", parse_treatment(F.col("drugname_drugconc"))) if "drugname_drugconc" in df.columns else df


def scan_feature_metadata(spark: SparkSession, path: str) -> DataFrame:
    """token_id, symbol, whichever of TOKEN_COLUMNS and SYMBOL_COLUMNS the table has; rows without an id are left out."""
    df = spark.read.parquet(f"{path}/metadata/gene_metadata.parquet")
    rows = df.select(F.col(_wanted(df, TOKEN_COLUMNS)).cast("long").alias("token_id"), F.col(_wanted(df, SYMBOL_COLUMNS)).cast("string").alias("symbol"))
    return rows.where("token_id is not null")


def schema_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: shards, n_rows, gene_count (-1 without a table of features) and columns (in the files' order) of a source.

    Rows are counted from the files' footers, no column is read.
    """
    cells = spark.read.parquet(f"{path}/data")
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/gene_metadata.parquet")
    there = table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table)
    genes = spark.read.parquet(f"{path}/metadata/gene_metadata.parquet").agg(F.count(F.lit(1)).alias("gene_count")) if there else spark.range(1).select(F.lit(-1).cast("long").alias("gene_count"))
    rows = cells.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.crossJoin(F.broadcast(genes)).select(F.lit(len(cells.inputFiles())).cast("long").alias("shards"), "n_rows", "gene_count", F.lit(",".join(cells.columns)).alias("columns"))


def shard_counts(spark: SparkSession, path: str) -> DataFrame:
    """file (the name of a shard), cell_line_id, n_cells."""
    cells = spark.read.parquet(f"{path}/data").select(F.col("_metadata.file_name").alias("file"), "cell_line_id")
    return cells.groupBy("file", "cell_line_id").agg(F.count("*").alias("n_cells"))


def stats_summary(spark: SparkSession, path: str, vocabulary: DataFrame, populations: list[str] | None = None) -> DataFrame:
    """One row: shards, n_rows, n_excluded, n_eligible and n_features of a source, in one pass over its observations.

    Rows count that are of the populations, if given. Eligible are controls, and treated rows with a structure and a finite
    dose of their sample. n_features: distinct features of the vocabulary (token_id, target_id) with a value in them.
    """
    cells = spark.read.parquet(f"{path}/data").select("genes", "cell_line_id", "sample", "drug", "canonical_smiles", F.col("_metadata.file_name").alias("file"))
    if populations is not None:
        cells = cells.where(F.col("cell_line_id").isin(list(populations)))
    doses = scan_sample_metadata(spark, path).groupBy("sample").agg(F.max("treatment.dose").alias("dose"))
    rows = cells.join(doses, "sample", "left")
    finite = F.col("dose").isNotNull() & ~F.isnan("dose") & (F.abs("dose") < float("inf"))
    eligible = F.coalesce((F.col("drug") == CONTROL_DRUG) | ((F.coalesce("canonical_smiles", F.lit("")) != "") & finite), F.lit(False))
    # a row for each file and feature before the shuffle; a null feature stands for the file's rows
    each = rows.select("file", eligible.alias("ok"), F.explode(F.concat(F.array(F.lit(None).cast("int")), F.when(eligible, F.col("genes")).otherwise(F.array().cast("array<int>")))).alias("token_id"))
    seen = each.groupBy("file", "token_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    known = vocabulary.groupBy("token_id").agg(F.max("target_id").alias("target_id"))
    joined = seen.join(known, "token_id", "left")
    is_row = F.col("token_id").isNull()
    return joined.agg(
        F.count_distinct("file").alias("shards"), F.coalesce(F.sum(F.when(is_row, F.col("n"))), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(is_row, F.col("n") - F.col("k"))), F.lit(0)).alias("n_excluded"),
        F.coalesce(F.sum(F.when(is_row, F.col("k"))), F.lit(0)).alias("n_eligible"), F.count_distinct("target_id").alias("n_features"),
    )


def read_ppi_edges(spark: SparkSession, links: str, proteins: str, features: DataFrame, threshold: int = 700) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, weight, both ways) between features (symbol, feature_id), and one row of figures.

    links: text, plain or gzipped, whose first line names protein1, protein2 and combined_score, by white space; proteins: tab
    separated with #string_protein_id and preferred_name. Scores over the threshold count; the best of a pair stays, over
    1000. Proteins without a feature, and links of a feature with itself, are left out. A line that can't be read is an error.
    Figures: raw_edges (over the threshold), mapped_proteins, mapped_features, undirected_edges, directed_edges.
    """
    from obsidia.operators.graph import undirected_max

    lines = spark.read.text(links)
    head = lines.where(F.contains("value", F.lit("protein1"))).first()
    names = head["value"].split() if head else []
    if missing := [c for c in ("protein1", "protein2", "combined_score") if c not in names]:
        raise ValueError(f"{links} has no {', '.join(missing)}")
    part = F.split(F.trim("value"), r"\s+")
    at = lambda c: F.get(part, F.lit(names.index(c)))
    body = lines.where((F.trim("value") != "") & (F.col("value") != head["value"]))
    scores = body.select(at("protein1").alias("p"), at("protein2").alias("q"), at("combined_score").cast("int").alias("score")).where(F.col("score") > threshold)
    info = spark.read.csv(proteins, sep="\t", header=True).select(F.col("`#string_protein_id`").alias("protein"), F.col("preferred_name").alias("symbol"))
    mapped = info.join(features.groupBy("symbol").agg(F.max("feature_id").alias("feature_id")), "symbol").groupBy("protein").agg(F.max("feature_id").alias("feature_id"))
    of = lambda side, name: mapped.select(F.col("protein").alias(side), F.col("feature_id").alias(name))
    edges = undirected_max(scores.join(of("p", "a"), "p").join(of("q", "b"), "q").select("a", "b", "score"), threshold)
    figures = mapped.agg(F.count(F.lit(1)).alias("mapped_proteins"), F.count_distinct("feature_id").alias("mapped_features"))
    counts = edges.agg(F.count_if(F.col("src") < F.col("dst")).alias("undirected_edges"), F.count(F.lit(1)).alias("directed_edges"))
    raw = scores.agg(F.count(F.lit(1)).alias("raw_edges"))
    return edges, raw.crossJoin(F.broadcast(figures)).crossJoin(F.broadcast(counts))  # one row each


def read_kg_edges(spark: SparkSession, path: str) -> DataFrame:
    """x_type, x_name, y_type, y_name of a knowledge graph's CSV; other columns are not read."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in ("x_type", "x_name", "y_type", "y_name") if c not in df.columns]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.select("x_type", "x_name", "y_type", "y_name")
