"""Ordinals and carried values within groups of any size.

A window sorts each group in one task; a group that holds a third of all rows is then the whole job.
Here rows are laid out in ranges over (group, order), so a large group spans many partitions; each
partition is numbered on its own and shifted by what the partitions before it hold of the group.  The
per-partition figures are one row a (group, partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamnan.functions.cluster import broadcast_if_small, cut_lineage

_INDEX_BITS = 33  # of monotonically_increasing_id


def _laid_out(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` in sorted ranges with its partition ``_p`` and its place in it ``_i``, written once: ranges are sampled, so they must not be drawn again."""
    keys = [*map(F.col, group), *[F.col(o) if isinstance(o, str) else o for o in order]]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys[len(group) :], names)])
    by = [*map(F.col, group), *[F.col(n) for n in names[: len(order)]]]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return cut_lineage(ranged.select("*", F.shiftright(at, _INDEX_BITS).alias("_p"), at.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("_i")).drop(*names))


def ordinal_within(df: DataFrame, group: list[str], order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """``df`` with the number, from 1, of each row within its group in a total order.  Null group keys form a group."""
    laid = _laid_out(df, group, order)
    held = laid.groupBy("_p", *group).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("_p", *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return _back(laid, shift, group).withColumn(name, F.col("_i") - F.col("_first") + F.col("_before") + 1).drop("_p", "_i", "_first", "_before")


def carried_within(df: DataFrame, group: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """``df`` with the last value that is not null at or before each row of its group."""
    laid = _laid_out(df.withColumn("_v", value), group, order)
    here = Window.partitionBy("_p", *group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    held = laid.groupBy("_p", *group).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_i"))).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("_p", *group, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    own = laid.withColumn("_own", F.last("_v", ignorenulls=True).over(here))
    return _back(own, shift, group).withColumn(name, F.coalesce("_own", "_before")).drop("_p", "_i", "_v", "_own", "_before")


def lagged_within(df: DataFrame, group: list[str], order: list[Column | str], columns: dict[str, str]) -> DataFrame:
    """``df`` with columns of the row before each in its group (old name: new name), joined by ordinal."""
    o = cut_lineage(ordinal_within(df, group, order, "_o"))
    names = [f"_b{i}" for i in range(len(group))]
    before = o.select((F.col("_o") + 1).alias("_o2"), *[F.col(g).alias(n) for g, n in zip(group, names)], *[F.col(a).alias(b) for a, b in columns.items()])
    same = F.col("_o") == F.col("_o2")
    for g, n in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return o.join(before, same, "left").drop("_o", "_o2", *names)


def islands_within(df: DataFrame, group: list[str], ts: str, order: list[Column | str], gap: Column, name: str = "island") -> DataFrame:
    """``df`` with the number, from 1, of each row's island: a row begins one if ``ts`` is more than ``gap`` after the row before.

    One layout: islands are numbered within partitions and shifted by what the partitions before hold of the group.
    """
    laid = _laid_out(df, group, order)
    here = Window.partitionBy("_p", *group).orderBy("_i")
    x = laid.withColumn("_s", F.coalesce((F.col(ts) - F.lag(ts).over(here)) > gap, F.lit(False)).cast("int"))
    x = x.withColumn("_run", F.sum("_s").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    held = x.groupBy("_p", *group).agg(F.min_by(ts, "_i").alias("_a"), F.max_by(ts, "_i").alias("_b"), F.sum("_s").alias("_n"))
    order_p = Window.partitionBy(*group).orderBy("_p")
    starts = F.coalesce((F.col("_a") - F.lag("_b").over(order_p)) > gap, F.lit(True)).cast("int")
    held = held.withColumn("_first", starts)
    shift = held.select("_p", *group, (F.sum(F.col("_first") + F.col("_n")).over(order_p.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return _back(x, shift, group).withColumn(name, F.col("_run") + F.col("_before")).drop("_p", "_i", "_s", "_run", "_before")


def _back(laid: DataFrame, shift: DataFrame, group: list[str]) -> DataFrame:
    names = [f"_g{i}" for i in range(len(group))]
    right = broadcast_if_small(shift.select(F.col("_p").alias("_q"), *[F.col(g).alias(n) for g, n in zip(group, names)], *[c for c in shift.columns if c not in ("_p", *group)]))
    same = F.col("_p") == F.col("_q")
    for g, n in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return laid.join(right, same).drop("_q", *names)
