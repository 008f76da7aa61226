"""Column functions that clean and parse treatment texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of dose buckets.
DOSE_BOUNDS = (0.21, 0.41, 0.71, 1.01, 1.51, 3.1, 4.1, 7.1, 12.1)
#: Texts that mean a missing value.
MISSING = ("", "nan", "none", "null")
TREATMENT = r"""^\[\(\s*(?:'([^']*)'|"([^"]*)")\s*,\s*([-+0-9.eE]+|nan|inf)\s*,\s*'([^']*)'\s*\)"""


def squash(c) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def null_like(c, *more: str) -> Column:
    """The text without outer spaces; null if it is null or, in any case, one of MISSING or of more."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING, *more), F.trim(c))


def parse_treatment(c) -> Column:
    """struct(drug, dose, unit) of the first entry of a list text; empty, NaN and empty where it can't be read."""
    name = F.concat(F.regexp_extract(c, TREATMENT, 1), F.regexp_extract(c, TREATMENT, 2))
    dose = F.coalesce(F.regexp_extract(c, TREATMENT, 3).try_cast("double"), F.lit(float("nan")))
    return F.struct(F.coalesce(name, F.lit("")).alias("drug"), dose.alias("dose"), F.coalesce(F.regexp_extract(c, TREATMENT, 4), F.lit("")).alias("unit"))


def combination_key(c) -> Column:
    """The components, in any order, as one key."""
    return F.concat_ws("|", F.array_sort(F.transform(c, lambda x: F.trim(x))))


def dose_bucket(dose, bounds) -> Column:
    """How many bounds lie below a dose; negative doses count as 0."""
    d = F.greatest(F.col(dose), F.lit(0.0))
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < d))


def dose_log(dose) -> Column:
    return F.log10(F.col(dose) + 1)


def log_dose(dose) -> Column:
    """Natural logarithm; null where a dose is not positive."""
    return F.when(F.col(dose) > 0, F.log(dose))


def bucketize(value, bounds) -> Column:
    """How many bounds are at most a value."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b <= F.col(value)))


def condition_key(population, key, doses) -> Column:
    """population, combination key and doses (an array), by pipe characters, the doses by commas."""
    plain = F.transform(doses, lambda d: F.regexp_replace(d.cast("string"), r"\.0$", ""))
    return F.concat_ws("|", population, key, F.array_join(plain, ","))


def normalise_name(c) -> Column:
    """Letters and digits of a name in lower case, without what stands in parentheses; Latin accents are dropped."""
    plain = F.translate(F.lower(c), "áàâäãåāçćčéèêëēíìîïīñńóòôöõōśšúùûüūýÿžźż", "aaaaaaaccceeeeeiiiiinnoooooossuuuuuyyzzz")
    return F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", " "), "[^a-z0-9]+", "")
