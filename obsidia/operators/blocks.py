"""Vectors of conditions, compared block by block: pairs of conditions never become rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Conditions of a block; a task holds two blocks of vectors.
BLOCK = 128


def vectors(rows: DataFrame, keys, columns) -> DataFrame:
    """A row for each group of keys: `feature`, the array of its feature_id, and an array of each of columns beside it."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct("feature_id", *columns)).alias("v"))
    return packed.select(*keys, F.col("v.feature_id").alias("feature"), *(F.col(f"v.{c}").alias(c) for c in columns))


def dense(table: pa.Table, columns, fill: float) -> list[np.ndarray]:
    """A matrix for each of columns, rows as in the table of vectors, over all features in it; what a row lacks is fill."""
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lengths = table.column("feature").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    vocabulary, place = np.unique(flat("feature"), return_inverse=True)
    row, found = np.repeat(np.arange(len(lengths)), lengths), []
    for c in columns:
        out = np.full((len(lengths), len(vocabulary)), fill)
        out[row, place] = flat(c)
        found.append(out)
    return found
