"""Running sums and places over a whole order, or over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import shared_dir, staged


def running(df: DataFrame, order: list[Column], by: list[str], **values: Column) -> DataFrame:
    """Adds, under each name, the sum of a value over the group's rows up to this one, itself included.

    Rows are dealt by ranges of (group, order) and written; each range is summed by
    itself, and what the ranges before it hold is added. No group is held by one task;
    only the totals, one row a range and group, meet in one. A null group is a group;
    an empty table gives no rows.
    """
    taken = {c.lower() for c in df.columns}
    no = next(f"range_no{'_' * i}" for i in range(len(taken) + 1) if f"range_no{'_' * i}" not in taken)
    dealt = df.repartitionByRange(*by, *order).withColumn(no, F.spark_partition_id())
    rows = staged(dealt, f"{shared_dir(df.sparkSession)}/ranges")
    local = Window.partitionBy(*by, no).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, no).agg(*(F.sum(v).alias(n) for n, v in values.items()))
    base = totals.select(
        *(F.col(c).alias(f"{no}_{i}") for i, c in enumerate(by)), F.col(no).alias(f"{no}_of"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{no}_{n}") for n in values)
    )
    meet = F.col(no) == F.col(f"{no}_of")
    for i, c in enumerate(by):
        meet = meet & F.col(c).eqNullSafe(F.col(f"{no}_{i}"))
    summed = rows.withColumns({n: F.sum(v).over(local) for n, v in values.items()}).join(base, meet)
    return summed.select(*(c for c in df.columns if c not in values), *((F.col(n) + F.col(f"{no}_{n}")).alias(n) for n in values))
