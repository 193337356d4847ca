"""The as-of join: to each row, the latest row of another table at or before it.

Both sides are put in one table and read in order; `last` over a window carries the latest row of the right side along. A
key's rows are cut into blocks of its order (of `width`), so that a key of any size is dealt over many tasks: within a block
the window finds the latest row, and what a block begins with is carried in from the blocks before by a second window over one row a
block. Nothing is joined pair by pair, and no side is broadcast.

Rows with a null key or order match nothing; left rows stay, with nulls. Of right rows with equal order, the one with the
greatest value stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16


def _block(on: str, kind: T.DataType, width: float) -> Column:
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    number = F.unix_micros(F.col(on).cast("timestamp")) if timed else F.col(on)
    return F.floor(number / width).cast("long")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], width: float = BLOCK, strict: bool = False) -> DataFrame:
    """left with the columns `values` of the last row of right with the same `by` and an order `on` that isn't greater (strict:
    that is less). on: a number or a timestamp; width: the extent of a block, of timestamps in microseconds."""
    held = F.struct(*(F.col(c) for c in values))
    kind = T.StructType([right.schema[c] for c in values])
    given = T.StructType(left.schema.fields)
    keys = [F.col(c) for c in [*by, on]]
    usable = F.lit(True)
    for c in keys:
        usable = usable & c.isNotNull()
    marks = left.select(*keys, F.lit(0 if strict else 1).alias("side"), F.struct(*left.columns).alias("given"), F.lit(None).cast(kind).alias("held"))
    others = right.where(usable).select(*keys, F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(given).alias("given"), held.alias("held"))
    rows = marks.union(others).withColumn("block", _block(on, left.schema[on].dataType, width))

    # what each block ends with, carried over the blocks after it
    ends = rows.where("held IS NOT NULL").groupBy(*by, "block").agg(F.max(F.struct(F.col(on).alias("at"), "held")).alias("end"))
    starts = rows.where(usable & F.col("given").isNotNull()).select(*by, "block").distinct().join(ends, [*by, "block"], "full")
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*by, "block", F.last("end.held", True).over(before).alias("carried")).where("carried IS NOT NULL")

    within = Window.partitionBy(*by, "block").orderBy(on, "side", "held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("own", F.last("held", True).over(within)).where("given IS NOT NULL")
    found = found.join(starts, [*by, "block"], "left")
    value = F.when(usable, F.coalesce("own", "carried"))
    return found.select("given.*", *(value[c].alias(f"last_{c}" if c in left.columns else c) for c in values))
