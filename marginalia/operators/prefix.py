"""Running sums and maxima over long ordered groups, in two levels.

A window over one key runs in one task, however long the key's history. Here the order column's range is cut into equal
pieces; windows run within (key, piece), and a short window over the pieces' totals gives what stands before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 256


def pieces(rows: DataFrame, order: str, n: int = PIECES) -> Column:
    """The piece, 0 to n - 1, of the range of a numeric order column in which a row stands; null orders are in piece -1."""
    low, high = rows.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    if low is None or low == high:
        return F.when(F.col(order).isNull(), -1).otherwise(0)
    piece = F.least(F.lit(n - 1), F.floor((F.col(order).cast("double") - F.lit(low)) * F.lit(n / (high - low)))).cast("int")
    return F.coalesce(piece, F.lit(-1))


def running(rows: DataFrame, key: str, order: str, value: Column, how: str, name: str, *ties: str) -> DataFrame:
    """rows with name: the sum or max of value over the rows of the key up to this one, by (order, ties)."""
    fold, join = (F.sum, lambda a, b: a + b) if how == "sum" else (F.max, F.greatest)
    inner = Window.partitionBy(key, "_piece").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.withColumn("_piece", pieces(rows, order)).withColumn("_value", value)
    totals = cut.groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_at")).agg(fold("_value").alias("_total"))
    before = totals.withColumn("_before", fold("_total").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))).drop("_total")
    here = cut.withColumn("_here", fold("_value").over(inner))
    out = here.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at")))
    return out.withColumn(name, F.when(F.col("_before").isNull(), F.col("_here")).otherwise(join(F.col("_here"), F.col("_before")))).drop("_piece", "_value", "_key", "_at", "_before", "_here")
