"""Packing of prioritised sections under a size budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: FIXED VALUES: entries kept of a list and of a map inside a section
LIST_HEAD, MAP_HEAD = 6, 18
#: Parts that an over-full group is first cut into.
SALT = 32


def trimmed(value: Column, kind: str) -> Column:
    """A list or map section cut to its first entries (a map's by key)."""
    if kind.startswith("array"):
        return F.slice(value, 1, LIST_HEAD)
    if kind.startswith("map"):
        return F.map_from_entries(F.slice(F.array_sort(F.map_entries(value)), 1, MAP_HEAD))
    return value


def budget_pack(sections: DataFrame, group: Sequence[str], order: str, name: str, value: str, budget: int) -> DataFrame:
    """Sections that go into each group's object of at most ``budget`` characters: in order (ties: by name),
    a section is taken if the object ``{"name":value,...}`` stays within the budget with it, and passed over if
    not. Returns the group columns, the order, the name, and ``used``, the object's size after it.

    ``value`` is JSON text, null counts as ``null``. Groups of any size: what remains of the budget only
    shrinks, so of the sections of one size those taken come first, and there are at most budget / size of
    them. Only these can matter; they are found by a limit within (group, size), first in salted parts, and the
    fold reads about budget * ln(budget) short entries of a group at the most."""
    cost = F.length(F.concat(F.lit('"'), F.col(name), F.lit('":'))) + F.length(F.coalesce(F.col(value), F.lit("null")))
    rows = sections.select(*group, F.col(order).alias("_order"), F.col(name).alias("_name"), cost.alias("_cost")).filter(F.col("_cost") + 2 <= budget)
    most = F.floor(F.lit(budget) / F.col("_cost"))
    salt = F.pmod(F.xxhash64("_order", "_name"), F.lit(SALT))
    for extra in ([salt], []):
        place = F.row_number().over(Window.partitionBy(*group, "_cost", *extra).orderBy("_order", "_name"))
        rows = rows.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    entry = F.struct("_order", "_name", "_cost")
    kind = f"struct<used:int,kept:array<struct<_order:{sections.schema[order].dataType.simpleString()},_name:string,used:int>>>"
    start = F.struct(F.lit(2).alias("used"), F.array().alias("kept")).cast(kind)

    def step(state: Column, e: Column) -> Column:
        after = state["used"] + e["_cost"] + F.when(F.size(state["kept"]) > 0, 1).otherwise(0)
        kept = F.concat(state["kept"], F.array(F.struct(e["_order"], e["_name"], after.alias("used"))))
        return F.when(after <= budget, F.struct(after.alias("used"), kept.alias("kept")).cast(kind)).otherwise(state)

    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("e")).withColumn("s", F.aggregate("e", start, step))
    return packed.select(*group, F.explode("s.kept").alias("k")).select(*group, F.col("k._order").alias(order), F.col("k._name").alias(name), F.col("k.used").alias("used"))
