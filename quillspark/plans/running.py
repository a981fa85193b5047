"""Running sums and ranks of keys with very many rows, in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, key: Column, order: list, cell: Column, value: Column, name: str, total: str | None = None) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over a key's rows up to and with each one in ``order``, and
    its sum over all of them as ``total``.

    ``cell`` must not fall along the order (a range of the first order column, say). Cells are
    summed first, combined map-side; windows then run over a key's cells, and over the rows
    of one cell, so no task holds a key's rows. All that remains of a key in one task is a row a cell.
    """
    d = df.withColumns({"_key": key, "_cell": cell, "_value": value})
    w = Window.partitionBy("_key")
    cells = d.groupBy("_key", "_cell").agg(F.sum("_value").alias("_sum"))
    up_to = F.sum("_sum").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.select(F.col("_key").alias("_k"), F.col("_cell").alias("_c"), (up_to - F.col("_sum")).alias("_before"), F.sum("_sum").over(w).alias("_total"))
    d = d.join(cells, d["_key"].eqNullSafe(cells["_k"]) & d["_cell"].eqNullSafe(cells["_c"]))
    inside = F.sum("_value").over(Window.partitionBy("_key", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = d.withColumn(name, F.col("_before") + inside)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_key", "_cell", "_value", "_k", "_c", "_before", "_total")
