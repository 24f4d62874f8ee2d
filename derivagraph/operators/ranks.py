"""Ranks, running sums and order statistics over whole tables without a task that sees them all.

Rows are range-partitioned and sorted, numbered inside their partition, and moved
up by the sums of the partitions before; only one row a partition (and group)
meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, bounded_broadcast


def _ranged(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` sorted by ``keys`` over range partitions, with ``_part`` and ``_m`` (place within it); written once, since range borders are sampled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    s = s.withColumn("_part", F.shiftright("_m", 33)).withColumn("_m", F.col("_m") - F.shiftleft(F.col("_part"), 33))
    return Scratch(df.sparkSession).cut(s)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], place: str = "i", size: str | None = None) -> DataFrame:
    """Adds ``place`` (0, 1, ... in ``order`` within ``by``) and, if named, ``size`` (rows of the group). ``order`` should be total; nulls come first."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    s = _ranged(df, [*[F.col(c) for c in by], *order])
    per = s.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_part", *[F.col(c).alias(f"_{c}") for c in by], (before - F.col("_first")).alias("_off"), F.sum("_n").over(w).alias("_size"))
    meet = s["_part"] == per["_part"]
    for c in by:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_{c}"))
    x = s.join(bounded_broadcast(per), meet)
    return x.select(*df.columns, (F.col("_off") + F.col("_m")).alias(place), *([F.col("_size").alias(size)] if size else []))


def running_sums(df: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """Adds ``name``: the sum of ``column`` over all rows up to and with this one in ``order`` (a total order), and ``name``_all, for each name and column of ``sums``."""
    s = _ranged(df, [order])
    per = s.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    per = per.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_{n}").over(Window.partitionBy()).alias(f"{n}_all") for n in sums])
    inner = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = s.select("*", *[F.sum(c).over(inner).alias(f"_i_{n}") for n, c in sums.items()]).join(bounded_broadcast(per), "_part")
    return x.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def smallest(values: DataFrame, column: str, k: int, bits: int = 60, few: int = 4_096) -> int | None:
    """The ``k``-th smallest (from 1) of non-negative integers below 2^bits, repeats counting; None with fewer than k.

    Counts by leading bits narrow the search 12 bits at a time (4,096 rows a
    pass); the last few values are sorted.
    """
    v = values.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    shift = bits
    while True:
        shift = max(0, shift - 12)
        rows = sorted((r["b"], r["n"]) for r in v.groupBy(F.shiftright("v", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        for b, n in rows:
            if k <= n:
                break
            k -= n
        else:
            return None
        v = v.filter(F.shiftright("v", shift) == b)
        if shift == 0:
            return b
        if n <= few:
            return sorted(r["v"] for r in v.collect())[k - 1]
