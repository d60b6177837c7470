"""Global ranks and running sums without one task that holds all rows: range partitions, then sums over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.plans.store import written


def running_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, by ``order``. Only one row a partition is gathered.

    The dealt rows are written: dealing them anew after a lost executor could cut the ranges elsewhere.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = parts.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(before), "__part").withColumn(out, F.col("__base") + own).drop("__part", "__base")  # one row a partition


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds the place of each row by ``order``, from 0."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out).drop("__one")


def bisect_depth(position: Column, low: Column, high: Column) -> Column:
    """Steps in which halving [low, high) reaches a position: a fold over 40 steps, enough for 2^40 positions."""
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.lit(-1).alias("depth"))

    def step(s: Column, k: Column) -> Column:
        middle = s["a"] + F.floor((s["b"] - s["a"]) / 2)
        open_ = (s["depth"] < 0) & (s["a"] < s["b"])
        return F.struct(
            F.when(open_ & (position > middle), middle + 1).otherwise(s["a"]).alias("a"),
            F.when(open_ & (position < middle), middle).otherwise(s["b"]).alias("b"),
            F.when(open_ & (position == middle), k.cast("int")).otherwise(s["depth"]).alias("depth"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, step, lambda s: s["depth"])


def spread_key(position: Column, n: Column) -> Column:
    """Order of sources: the first, the last, then halves of those between."""
    return F.when(position == 0, -2).when(position == n - 1, -1).otherwise(bisect_depth(position, F.lit(1), n - 1))
