"""Control flags, eligible rows, vocabularies and components of treatments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from obsidia.functions.text import combination_key, null_like

#: Names of controls, and texts of a flag that mean a control.
CONTROL_NAMES = ("control", "ctrl", "dmso", "dmso_tf", "mock", "negative control", "untreated", "vehicle", "vehicle control")
CONTROL_FLAGS = ("1", "true", "yes", "control", "vehicle", "dmso")


def is_control(*names: str, known=CONTROL_NAMES) -> Column:
    """One of the columns holds, in any case, one of the known names of controls; nulls don't. Sources differ in these names."""
    found = [F.coalesce(F.lower(F.trim(n)).isin(*known), F.lit(False)) for n in names]
    return F.greatest(*found) if len(found) > 1 else found[0]


def control_flag(df: DataFrame, flag: str, drug: str, known=CONTROL_NAMES) -> Column:
    """The flag is true, not 0, or a text of CONTROL_FLAGS, or the drug is a control's name; null flags count as unset."""
    kind = df.schema[flag].dataType
    if isinstance(kind, BooleanType):
        told = F.col(flag)
    elif isinstance(kind, NumericType):
        told = F.col(flag) != 0
    else:
        told = F.lower(flag).isin(*CONTROL_FLAGS)
    return F.coalesce(told, F.lit(False)) | is_control(drug, known=known)


def condition_fields(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows (sample, raw_drug, raw_smiles, ...) with drug, the metadata's or else the raw one, and smiles, null if null-like.

    metadata (sample, drug) has a row for each sample; repeated samples take the least drug.
    """
    known = metadata.groupBy("sample").agg(F.min(null_like("drug")).alias("known"))
    joined = rows.join(known, "sample", "left")
    return joined.select(*rows.columns, F.coalesce("known", null_like("raw_drug")).alias("drug"), null_like("raw_smiles").alias("smiles"))


def eligibility(rows: DataFrame) -> DataFrame:
    """rows (is_control, smiles, dose, ...) with eligible: controls, and treated rows of a structure and a finite dose."""
    finite = F.col("dose").isNotNull() & ~F.isnan("dose") & (F.abs("dose") < float("inf"))
    return rows.withColumn("eligible", F.coalesce("is_control", F.lit(False)) | (null_like("smiles").isNotNull() & finite))


def select_populations(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of the wanted populations. An empty list, or a population without rows, is an error."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        raise ValueError("no population is wanted")
    kept = rows.where(F.col("population").isin(wanted))
    found = {r[0] for r in kept.select("population").distinct().collect()}  # at most as many as are wanted
    if missing := [w for w in wanted if w not in found]:
        raise ValueError(f"no rows of {', '.join(missing)}")
    return kept


def map_features(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token_id, target_id: tokens (token_id, symbol) by the symbol in vocabulary (target_id, symbol).

    Of repeated symbols of the vocabulary the greatest target_id counts; null symbols match nothing.
    """
    last = vocabulary.where("symbol is not null").groupBy("symbol").agg(F.max("target_id").alias("target_id"))
    return tokens.join(last, "symbol").select("token_id", "target_id")


def unmapped_features(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Symbols of the vocabulary which no token has."""
    return vocabulary.select("symbol").where("symbol is not null").distinct().join(tokens, "symbol", "left_anti")


def row_components(rows: DataFrame, drugs: list[str], doses: list[str], smiles: list[str]) -> DataFrame:
    """rows with components, array<struct(smiles, dose, name)> in that order, combination_key and is_control.

    Null-like names and names of controls are no components; a row without components is a control.
    """
    every = F.array(*(F.struct(F.coalesce(null_like(s), F.lit("")).alias("smiles"), F.col(d).cast("double").alias("dose"), null_like(n).alias("name")) for n, d, s in zip(drugs, doses, smiles)))
    real = F.filter(every, lambda c: c["name"].isNotNull() & ~F.lower(c["name"]).isin(*CONTROL_NAMES))
    out = rows.withColumn("components", F.array_sort(real))
    key = combination_key(F.transform("components", lambda c: F.coalesce(F.nullif(c["smiles"], F.lit("")), c["name"])))
    return out.withColumns({"combination_key": key, "is_control": F.size("components") == 0})


def distinct_vocabulary(rows: DataFrame) -> DataFrame:
    """drug, names (sorted), n_rows of exploded components."""
    each = rows.select(F.explode("components").alias("c"))
    return each.groupBy(F.coalesce(F.nullif(F.col("c.smiles"), F.lit("")), F.col("c.name")).alias("drug")).agg(F.array_sort(F.collect_set("c.name")).alias("names"), F.count("*").alias("n_rows"))
