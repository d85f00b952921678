"""Running sums, carried values and row numbers in a total order, over a whole table or inside keys, without a task that holds either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged


def _dealt(df: DataFrame, keys: Sequence[str], order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """df in ranges (__range) of keys and order, written, and its rows whose key may go on in another range.

    Such keys are the first or last of a range, so there are at most two for each range,
    of which there are as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    if not keys:
        return dealt, dealt
    key = F.struct(*keys)
    ends = dealt.groupBy("__range").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("k")).select("__range", F.explode("k").alias("k")).select("__range", "k.*")
    return dealt, dealt.join(F.broadcast(ends), ["__range", *keys])


def running_sums(df: DataFrame, order: list[Column | str], keys: Sequence[str] = (), **sums: Column | str) -> DataFrame:
    """df with, for each entry of sums, its sum over the rows before in the order, which must have no ties; inside each value of keys (not null), if given.

    Rows are dealt to ranges of keys and order and written, so that a large key is split.
    Sums run inside each range, and over the totals of the ranges.
    """
    dealt, edges = _dealt(df, keys, order)
    totals = edges.groupBy("__range", *keys).agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *keys, *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), ["__range", *keys], "left")
    return out.withColumns({k: F.coalesce(f"__{k}", F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).drop("__range", *(f"__{k}" for k in sums))


def running_last(df: DataFrame, order: list[str], keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with name: the last value that is not null over the rows before in the ascending order inside keys (not null); which of rows with ties comes first is open.

    Ranges as in running_sums(): the last value of a key in a range is carried to its rows in the next ones.
    """
    dealt, edges = _dealt(df, keys, order)
    held = edges.where(F.col(value).isNotNull()).groupBy("__range", *keys).agg(F.max_by(value, F.struct(*order)).alias("__value"))
    every = edges.select("__range", *keys).distinct().join(held, ["__range", *keys], "left")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("__range", *keys, F.last("__value", ignorenulls=True).over(before).alias("__carried"))
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(carried), ["__range", *keys], "left")
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "__carried")).drop("__range", "__carried")


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with a long column name that counts the rows from 1 in the order, which must have no ties."""
    return running_sums(df, order, **{name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("long"))
