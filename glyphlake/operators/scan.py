"""Running values over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.sources.store import stored


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs), F.lit(True))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, peaks: dict[str, str] | None = None, previous: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """Adds, for each row of a group in order, itself included: sums, largest values, its number from 1, and values of the row before.

    ``sums``, ``peaks`` and ``previous`` name a new column and the column it is
    of. Rows are sorted by ranges of (keys, order), so that a group with most
    of the rows is dealt to many tasks; each range then needs only what the
    ranges before it come to, one row for each range that a group touches. For
    many small groups a plain window does the same with one shuffle.
    """
    sums, peaks, previous = sums or {}, peaks or {}, previous or {}
    place = [*keys, *order]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    table = stored(dealt.withColumn("_part", F.spark_partition_id()))
    last = F.struct(*order)
    totals = table.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_count"),
        *(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()),
        *(F.max(c).alias(f"_peak_{n}") for n, c in peaks.items()),
        *(F.max_by(c, last).alias(f"_last_{n}") for n, c in previous.items()),
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_part").alias("_p"),
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count"),
        *(F.sum(f"_sum_{n}").over(earlier).alias(f"_sum_{n}") for n in sums),
        *(F.max(f"_peak_{n}").over(earlier).alias(f"_peak_{n}") for n in peaks),
        *(F.last(f"_last_{n}").over(earlier).alias(f"_last_{n}") for n in previous),
    )
    both = table.join(carried, null_safe(table, carried, [("_part", "_p"), *((k, f"_key_{k}") for k in keys)]))
    group = Window.partitionBy("_part", *keys).orderBy(*order)
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(group)
    found = {
        **{k: F.coalesce(F.col(f"_sum_{k}"), F.lit(0)) + F.sum(c).over(upto) for k, c in sums.items()},
        **{k: F.greatest(F.col(f"_peak_{k}"), F.max(c).over(upto)) for k, c in peaks.items()},
        **{k: F.when(n == 1, F.col(f"_last_{k}")).otherwise(F.lag(c).over(group)) for k, c in previous.items()},
        **({number: F.col("_count") + n} if number else {}),
    }
    return both.select(*rows.columns, *(c.alias(k) for k, c in found.items()))
