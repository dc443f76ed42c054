"""Ordered per-key computations that survive hot keys.

A plain `Window.partitionBy(key)` puts all rows of a key into one task. One pid,
connection or identity may hold a third of the data, so these helpers cut every
key into slices (usually of time), run the window inside (key, slice), and carry
one summary row per slice across the slices. Results equal the plain window.

Row-sized data is shuffled once, on (key, slice); the carried summaries have one
row per (key, slice) and get there by map-side aggregation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def time_slice(ts: Column, width: int) -> Column:
    return F.floor(ts / F.lit(width)).cast("bigint")


def _frames(keys, order):
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return inside, before


def running(df: DataFrame, keys, order, slice_by: Column, **aggs) -> DataFrame:
    """Add inclusive running aggregates: name=("sum"|"min"|"max", column)."""
    inside, before = _frames(keys, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    sliced = df.withColumn(SLICE, slice_by)
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(*[fn[kind](col).alias(name) for name, (kind, col) in aggs.items()])
        .select(*keys, SLICE, *[fn[kind](name).over(before).alias(f"_o_{name}") for name, (kind, _) in aggs.items()])
    )
    local = sliced.select("*", *[fn[kind](col).over(upto).alias(f"_l_{name}") for name, (kind, col) in aggs.items()])

    def merged(name, kind):
        here, carried = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.least(here, carried) if kind == "min" else F.greatest(here, carried)

    joined = local.join(offsets, [*keys, SLICE], "left")
    return joined.select(*df.columns, *[merged(n, kind).alias(n) for n, (kind, _) in aggs.items()])


def sequence_number(df, keys, order, slice_by, name="seq") -> DataFrame:
    """1-based position of each row in its key's order."""
    return running(df, keys, order, slice_by, **{name: ("sum", F.lit(1).cast("bigint"))})


def carry_last(df: DataFrame, keys, order, slice_by: Column, value: Column, name: str, inclusive=True) -> DataFrame:
    """Latest non-null `value` at or before each row (before it, if not inclusive)."""
    inside, before = _frames(keys, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    sliced = df.withColumn(SLICE, slice_by).withColumn("_v", value)
    position = F.when(F.col("_v").isNotNull(), F.struct(*order))
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.max_by("_v", position).alias("_v"))
        .select(*keys, SLICE, F.last("_v", ignorenulls=True).over(before).alias("_o"))
    )
    local = sliced.select("*", F.last("_v", ignorenulls=True).over(upto).alias("_l"))
    joined = local.join(offsets, [*keys, SLICE], "left")
    return joined.select(*df.columns, F.coalesce("_l", "_o").alias(name))
