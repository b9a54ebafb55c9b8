"""Window-shaped computations, all partitioned by company (never a global window),
and top-k helpers (SURVEY 2.6) with a total order (primary key appended as tie-break)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def revenue_change(monthly: DataFrame) -> DataFrame:
    """Each present month vs the previous present month (first month compares with itself)."""
    w = Window.partitionBy("company_id").orderBy("month")
    prev = F.coalesce(F.lag("revenue").over(w), F.col("revenue"))
    rev_d, prev_d = F.col("revenue").cast("double"), prev.cast("double")
    change = F.when(prev_d != 0, F.round((rev_d - prev_d) / prev_d * 100, 1)).otherwise(F.lit(0.0))
    return monthly.select("company_id", "month", F.round(rev_d, 2).alias("revenue"),
                          F.round(prev_d, 2).alias("previous_revenue"), change.alias("revenue_change"))


def last_n_months(monthly: DataFrame, n: int = 6) -> DataFrame:
    """Latest n present months with a short month label."""
    w = Window.partitionBy("company_id").orderBy(F.col("month").desc())
    return (monthly.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .select("company_id", "month",
                    F.date_format(F.to_date(F.concat(F.col("month"), F.lit("-01"))), "MMM").alias("label"),
                    F.round(F.col("revenue").cast("double"), 2).alias("revenue"),
                    F.round(F.col("expenses").cast("double"), 2).alias("expenses")))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Global top-k: TakeOrderedAndProject (each task keeps k rows, the driver merges k x tasks)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Top-k within each group via row_number over (keys); each task keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def ordinal(df: DataFrame, by: Sequence[str], key: str, name: str, prefix: int = 8) -> DataFrame:
    """``df`` with the place (from 1) of each row in ``key`` order within ``by``, without one task that
    holds a whole group: rows are numbered within buckets of keys that share their first ``prefix``
    characters, and the sizes of the buckets before are added. Equal prefixes keep the order of the
    keys, so the numbers are those of one window over the group."""
    b = df.withColumn("_b", F.substring(F.col(key), 1, prefix))
    sizes = b.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_b").orderBy(key)
    return (b.join(sizes, [*by, "_b"]).withColumn(name, F.col("_before") + F.row_number().over(within))
            .drop("_b", "_before"))
