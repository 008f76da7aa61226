"""Observation metadata of any source brought to one form, with its faults as a table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from obsidia.functions.text import MISSING
from obsidia.operators.cleaning import CONTROL_NAMES, control_flag, is_control

#: The columns that each field is read from, the first of them that a table has, in any case.
ALIASES = {
    "cell_id": ("obs_id", "cell_id", "cell", "barcode", "cell_barcode"),
    "population": ("cell_type", "cell_line", "cell_line_id", "celltype", "cell.line"),
    "drug": ("sm_name", "product_name", "drug_name", "drug", "condition", "perturbation", "treatment"),
    "smiles": ("SMILES", "smiles", "canonical_smiles", "canonical_isomeric_smiles"),
    "dose": ("dose_uM", "dose_um", "dose", "dose_val", "dose_value", "concentration"),
    "control": ("control", "is_control", "vehicle"),
    "group": ("plate", "plate_name", "batch", "batch_id", "replicate", "sample"),
}
REQUIRED = ("population", "drug")
#: Columns of a table of structures, and a further text that means a missing structure.
NAME_ALIASES = ("drug_name", "name", "sm_name", "product_name", "condition")
SMILES_ALIASES = ("canonical_smiles", "smiles", "SMILES")
NO_STRUCTURE = (*MISSING, "xxx")


def choose_column(columns: list[str], aliases, wanted: str | None = None, required: str | None = None) -> str | None:
    """The wanted column, which must be there, or the first alias that is, in any case; required names what must be found."""
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"no column {wanted} among {', '.join(columns)}")
        return wanted
    known = {c.lower(): c for c in columns}
    found = next((known[a.lower()] for a in aliases if a.lower() in known), None)
    if found is None and required:
        raise ValueError(f"no column for {required} among {', '.join(columns)}")
    return found


def structure(c: Column) -> Column:
    """A structure's text without outer white space; empty if it is null or means a missing one."""
    return F.when(c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*NO_STRUCTURE), F.lit("")).otherwise(F.trim(c.cast("string")))


def smiles_lookup(table: DataFrame) -> DataFrame:
    """key (the name, trimmed, in lower case), smiles of a table of structures, whose columns go by NAME_ALIASES and
    SMILES_ALIASES. Rows without a name or structure are left out; of repeated names the greatest structure counts."""
    name = choose_column(table.columns, NAME_ALIASES, required="drug name")
    smiles = choose_column(table.columns, SMILES_ALIASES, required="structure")
    rows = table.select(F.lower(F.trim(F.col(f"`{name}`").cast("string"))).alias("key"), structure(F.col(f"`{smiles}`")).alias("smiles"))
    return rows.where("key is not null and smiles <> ''").groupBy("key").agg(F.max("smiles").alias("smiles"))


def normalise_metadata(rows: DataFrame, schema: dict[str, str] | None = None, structures: DataFrame | None = None, default_dose: float | None = None, dose_unit: str = "uM", control_names=CONTROL_NAMES) -> tuple[DataFrame, dict[str, str | None]]:
    """cell_id, population, drug, dose, dose_unit, canonical_smiles, control, matching_group and fault of every row, and the
    column that each field was read from.

    Columns go by `schema` (field -> column), else by ALIASES; population and drug must be found. Drug names are trimmed; a
    control is a flag (see `control_flag`) or a drug of control_names. Controls have dose 0 and no structure. Other doses are
    numbers, null where they can't be read; without a column, default_dose. A structure is the row's own or, if that is
    missing, the one of its name in `structures` (a table for `smiles_lookup`). Null populations become `unknown`, null groups
    and a missing column `default`; without an id column rows get ids in no order.

    fault: `dose` for a treated row without a finite dose, `structure` for one without a structure (the first that holds),
    else null. See `metadata_faults` and `checked`.
    """
    schema = schema or {}
    if unknown := set(schema) - set(ALIASES):
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    at = {f: choose_column(rows.columns, a, schema.get(f), f if f in REQUIRED else None) for f, a in ALIASES.items()}
    column = lambda f: F.col(f"`{at[f]}`")
    text = lambda f: column(f).cast("string")
    base = rows.withColumn("_drug", F.trim(F.coalesce(text("drug"), F.lit(""))))
    if at["control"]:
        base = base.withColumn("_flag", column("control"))
        control = control_flag(base, "_flag", "_drug", control_names)
    else:
        control = is_control("_drug", known=control_names)
    base = base.withColumn("_control", control)
    dose = text("dose").try_cast("double") if at["dose"] else F.lit(default_dose).cast("double")
    own = structure(column("smiles")) if at["smiles"] else F.lit("")
    out = base.select(
        (text("cell_id") if at["cell_id"] else F.concat(F.lit("cell-"), F.monotonically_increasing_id().cast("string"))).alias("cell_id"),
        F.coalesce(text("population"), F.lit("unknown")).alias("population"), F.col("_drug").alias("drug"),
        F.when(F.col("_control"), 0.0).otherwise(dose).alias("dose"), F.lit(dose_unit).alias("dose_unit"),
        F.when(F.col("_control"), F.lit("")).otherwise(own).alias("canonical_smiles"), F.col("_control").alias("control"),
        (F.coalesce(text("group"), F.lit("default")) if at["group"] else F.lit("default")).alias("matching_group"),
    )
    if structures is not None:
        known = smiles_lookup(structures).withColumnRenamed("smiles", "_known")
        out = out.join(known, (F.lower("drug") == F.col("key")) & ~F.col("control") & (F.col("canonical_smiles") == ""), "left")
        out = out.withColumn("canonical_smiles", F.coalesce("_known", "canonical_smiles")).drop("key", "_known")
    finite = F.col("dose").isNotNull() & ~F.isnan("dose") & (F.abs("dose") < float("inf"))
    fault = F.when(~F.col("control") & ~finite, "dose").when(~F.col("control") & (F.col("canonical_smiles") == ""), "structure")
    return out.withColumn("fault", fault), at


def metadata_faults(clean: DataFrame) -> DataFrame:
    """fault, drug, n: rows with each fault."""
    return clean.where("fault is not null").groupBy("fault", "drug").agg(F.count("*").alias("n"))


def checked(clean: DataFrame) -> DataFrame:
    """clean without the column fault, if no row has one; else an error that names some drugs."""
    found = metadata_faults(clean).orderBy("fault", "drug").limit(8).collect()
    if found:
        raise ValueError("treated rows without " + "; ".join(f"{r['fault']}: {r['drug']}" for r in found))
    return clean.drop("fault")


def values_of(df: DataFrame, column: str) -> Column:
    """A column of scalars, arrays, or texts as an array of texts: a text that is a list, in JSON or in parentheses, of
    which the first list counts where lists are nested; any other text is one value. Null and blank ones are empty."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    none = F.array().cast("array<string>")
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, ArrayType):
            c = F.get(c, F.lit(0))
        return F.coalesce(c.cast("array<string>"), none)
    if not isinstance(kind, StringType):
        return F.when(c.isNull(), none).otherwise(F.array(c.cast("string")))
    listed = lambda t: F.from_json(F.regexp_replace(F.regexp_replace(F.trim(t), r"^\(", "["), r",?\s*\)$", "]"), "array<string>")
    is_list = lambda t: F.trim(t).rlike(r"^[\[(]")
    outer = F.when(is_list(c), listed(c))
    first = F.get(outer, F.lit(0))
    inner = F.when(is_list(first), listed(first))
    return F.when(c.isNull() | (F.trim(c) == ""), none).otherwise(F.coalesce(inner, outer, F.array(c)))


def normalise_components(rows: DataFrame, smiles: str = "smiles", doses: str = "doses") -> DataFrame:
    """rows with component_smiles, component_doses (arrays of the same length) and fault.

    Either column may hold scalars, arrays or list texts (see `values_of`). No dose counts as 0 for all components, a single
    one goes to all. fault, the first that holds, else null: `empty` without components, `length` where the numbers differ,
    `structure` for a null or blank component, `dose` for one that is no number, not finite or negative.
    """
    s = F.transform(values_of(rows, smiles), lambda x: F.trim(x))
    d = F.transform(values_of(rows, doses), lambda x: x.try_cast("double"))
    held = rows.withColumns({"component_smiles": s, "_d": d})
    n, m = F.size("component_smiles"), F.size("_d")
    held = held.withColumn("component_doses", F.when(m == 0, F.array_repeat(F.lit(0.0), n)).when((m == 1) & (n > 1), F.array_repeat(F.get("_d", F.lit(0)), n)).otherwise(F.col("_d"))).drop("_d")
    bad = lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
    fault = F.when(n == 0, "empty").when(n != F.size("component_doses"), "length").when(F.exists("component_smiles", lambda x: x.isNull() | (x == "")), "structure").when(F.exists("component_doses", bad), "dose")
    return held.withColumn("fault", fault)
