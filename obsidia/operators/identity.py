"""Digests of ordered tables, and what depends on them."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose text is digested together; the digests of such stretches are digested in order.
STRETCH = 1000


def ordered_digest(rows: DataFrame, place: str, columns: list[str], stretch: int = STRETCH) -> DataFrame:
    """One row, n and digest: the same for the same rows in the same order, however they are partitioned.

    place holds the row numbers from 0. Each stretch of places is joined in order and digested on its own; the stretches'
    digests, in order, are digested again. Null values differ from empty ones. A place that is missing or stands twice
    changes n or the text, as places are part of it; null places are an error.
    """
    checked = F.coalesce(F.col(place), F.raise_error(F.lit("a row without a place")).cast("long"))
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    named = rows.select(checked.alias("p"), F.concat_ws(":", checked.cast("string"), *map(value, columns)).alias("t"))
    parts = named.groupBy(F.expr(f"p div {stretch}").alias("s")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda e: e["t"]), "\n").alias("t"))
    digests = parts.select("s", "n", F.sha2("t", 256).alias("d"))
    return digests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "d"))), lambda e: e["d"]), "\n"), 256).alias("digest"))


def feature_fingerprint(selected: DataFrame, protocol: dict) -> DataFrame:
    """One row, n and fingerprint, of selected features (place, feature_id) in their order and of how they were chosen.

    protocol is written as JSON with sorted names, so the order of its members does not count; that of lists does.
    """
    text = json.dumps(protocol, sort_keys=True, separators=(",", ":"))
    return ordered_digest(selected, "place", ["feature_id"]).select("n", F.sha2(F.concat_ws("|", F.lit(text), "digest"), 256).alias("fingerprint"))


def check_fingerprints(tables: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """name, fault of tables (name, fingerprint): `missing` without a fingerprint, `other` where it is not the one row's."""
    held = tables.select("name", F.col("fingerprint").alias("held")).crossJoin(F.broadcast(fingerprint.select("fingerprint")))
    fault = F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("fingerprint"), "other")
    return held.select("name", fault.alias("fault")).where("fault is not null")
