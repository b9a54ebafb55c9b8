"""Spans of patterns in whole texts with SQL functions only: a text is split at a pattern's matches, and the
lengths of what lies between and of the matches add up to places in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, guard: Column | None = None, left: int = 0) -> Column:
    """Array of (gap: length of what lies between the last match and this one; left: its last ``left``
    characters; value: the match), leftmost and non-overlapping. ``guard`` spares texts that cannot
    match. The pattern never matches the empty string."""
    # gaps and matches side by side; the last gap has no match
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), (F.right(gap, F.lit(left)) if left else F.lit("")).alias("left"), value.alias("value")),
    )
    found = F.filter(pairs, lambda m: m["value"].isNotNull())
    if guard is None:
        return found
    return F.when(guard, found).otherwise(F.lit(None))


def placed(rows: DataFrame, kinds: dict[str, str], by: str = "key") -> DataFrame:
    """``(key, kind, left, value, start, end)`` of all matches. ``kinds`` maps a kind to the column that
    has its ``matches``; rows have distinct keys. Places run up within one text and kind, so no array is
    built up twice."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("found")) for k, c in kinds.items()])
    each = rows.select(by, F.explode(parts).alias("p")).select(by, "p.kind", F.posexplode("p.found").alias("nth", "m"))
    each = each.select(by, "kind", "nth", F.col("m.gap").cast("long").alias("gap"), F.col("m.left").alias("left"), F.col("m.value").alias("value"), F.length("m.value").cast("long").alias("size"))
    upto = Window.partitionBy(by, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).select(by, "kind", "left", "value", "start", "end")


#: Width in characters of a cell of the interval joins.
CELL = 256


def meeting(one: DataFrame, other: DataFrame, reach: int = 0, by: str = "key") -> DataFrame:
    """Rows of ``one`` that some row of ``other`` in the same text meets: at most ``reach`` characters lie
    between them, or with reach 0 they overlap. With a reach, rows that overlap do not count, so that no
    span completes itself. A semi-join on cells of the text makes no pairs, and a cell holds few spans
    however many the text has."""

    def cells(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / CELL), F.floor(last / CELL)))

    a = one.withColumn("cell", cells(F.greatest(F.lit(0), F.col("start") - reach), F.col("end") + reach))
    b = other.select(F.col(by).alias("other_by"), F.col("start").alias("s"), F.col("end").alias("e"), cells(F.col("start"), F.col("end")).alias("other_cell")).distinct()
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    close = apart & (F.col("s") <= F.col("end") + reach) & (F.col("e") >= F.col("start") - reach) if reach else ~apart
    return a.join(b, (F.col(by) == F.col("other_by")) & (F.col("cell") == F.col("other_cell")) & close, "left_semi").drop("cell").distinct()


def outside(one: DataFrame, other: DataFrame, by: str = "key") -> DataFrame:
    """Distinct rows of ``one`` that overlap no row of ``other`` in the same text."""
    return one.subtract(meeting(one, other, by=by))


def joined(spans: DataFrame, order: list[str], name: str, by: str = "key", where: Column | None = None) -> Column:
    """Aggregate: ``kind:start:end`` by start, then kind in the given order, comma-joined."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    item = F.struct(F.col("start"), place.alias("place"), F.col("end"), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.when(where, item) if where is not None else item))
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias(name)
