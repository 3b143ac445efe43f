"""Event-time alignment of feeds: as-of joins in one shuffle by union and last known value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.ordered import carried_forward


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str = "dt", columns: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Every row of `left` with the given columns of the last row of `right` at or before its time (before it, if not inclusive).

    Both sides are put in one ordered sequence for each key; the right side's last values are carried on. A key's rows are
    streamed through a window and not held as a group. Ties: right rows first if inclusive, else last.
    """
    columns = columns or [c for c in right.columns if c not in (*keys, on)]
    side = 0 if inclusive else 1
    packed = right.select(*keys, on, F.struct(*columns).alias("_r"), F.lit(side).alias("_side"), F.lit(None).cast(_struct(left, keys, on)).alias("_l"))
    rest = [c for c in left.columns if c not in (*keys, on)]
    own = left.select(*keys, on, F.lit(None).cast(packed.schema["_r"].dataType).alias("_r"), F.lit(1 - side).alias("_side"), (F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))).alias("_l"))
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = own.unionByName(packed).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1 - side)
    return carried.select(*keys, on, *(F.col("_l")[c].alias(c) for c in rest), *(F.col("_r")[c].alias(c) for c in columns))


def _struct(df: DataFrame, keys: list[str], on: str):
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name not in (*keys, on)]
    return T.StructType(fields or [T.StructField("_one", T.IntegerType())])


def merge_feeds(feeds: dict[str, DataFrame], value: str = "close", on: str = "dt") -> DataFrame:
    """A row for every time that any feed has, with each feed's value as of then; the series is worked on in ranges of time."""
    marked = [f.select(on, *(F.col(value).cast("double").alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in feeds)) for name, f in feeds.items()]
    rows = reduce(DataFrame.unionByName, marked).groupBy(on).agg(*(F.max(n).alias(n) for n in feeds))
    return carried_forward(rows, on, list(feeds))


def merge_symbols(bars: DataFrame, group: Column, value: str = "close", on: str = "dt") -> DataFrame:
    """Long form of `merge_feeds` for any number of symbols: every symbol's value as of every time of its group, so the result
    has (times x symbols) rows for each group; groups of symbols that trade together keep it in proportion."""
    times = bars.select(group.alias("grp"), on).distinct()
    symbols = bars.select(group.alias("grp"), "symbol").distinct()
    grid = times.join(symbols, "grp")
    return as_of(grid, bars.select(group.alias("grp"), "symbol", on, value), ["grp", "symbol"], on, [value])


def couple(fast: DataFrame, slow: DataFrame, columns: list[str], completed: bool = True, keys: list[str] | None = None) -> DataFrame:
    """A slower feed's columns on a faster clock; `completed` shows a slow bar only after its time."""
    return as_of(fast, slow, keys or ["symbol"], "dt", columns, inclusive=not completed)
