"""Mixing sources to target weights: tokens per source are aggregated, targets are shared out by weight
under a cap, and every document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with
probability equal to the fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, text_of

#: Weights of the sources in code-point order, repeating; the share of all sizes that is taken; and how
#: often a source may be repeated.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Coin seeds a source may take: the one whose copies come closest to its target.
SEEDS = 8
SALT = "mix"


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in the given order, from 0. Ranges are sorted apart, and only
    the sizes of the ranges meet."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("task", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("task").count().collect()  # one number for each range
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["task"]):
        before[r["task"]] = total
        total += r["count"]
    if not before:
        return rows.select(*df.columns, F.lit(0).cast("long").alias(name))
    steps = spark.createDataFrame(list(before.items()), "task long, before long")
    return rows.join(F.broadcast(steps), "task").select(*df.columns, (F.col("place") + F.col("before")).alias(name))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``: ``share`` of all sizes
    dealt out by weight, with targets stopped at ``most`` times their source's size and the excess
    dealt out again until none is above. Only sums reach the driver."""
    order = [F.col("source").asc_nulls_last()]
    rows = ranked(sizes, order, "rank")
    rows = cut(rows.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")))
    cap = most * F.col("source_size")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        n, at_cap, weight = rows.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size")).otherwise(0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        if n == stopped or not weight:
            break
        stopped, level = n, (total - most * float(at_cap)) / weight
    level = level if weight else float("inf")
    target = F.when(F.col("weight") * level > cap, cap).otherwise(F.col("weight") * level) if weight else cap
    return rows.withColumn("target", target)


def _draw(key: Column) -> Column:
    """64 hex digits that a document's coins come from."""
    return F.sha2(F.concat(F.lit(SALT + ":"), key), 256)


def _coin(draw: Column, seed: Column) -> Column:
    """Uniform in [0, 1): eight hex digits of the draw, from the place that the seed names."""
    return F.conv(F.substring(draw, seed * 8 + 1, F.lit(8)), 16, 10).cast("long") / float(1 << 32)


def _doc_key(text: Column) -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.sha2(text, 256)))


def _copies(rate: Column, draw: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(_coin(draw, seed) < rate - whole, 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), _draw(_doc_key(text_of())).alias("draw"))


def _rates(sized: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``(source, source_size, target, rate, seed)``. A source without words has rate 0."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = cut(targets(by_source, weights, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)))
    taken = [F.sum(F.col("size") * _copies(F.col("rate"), F.col("draw"), F.lit(k))).alias(f"taken{k}") for k in range(SEEDS)]
    # as a key, a null source must meet the null source
    joined = _with_source(sized, rates.select("source", "rate"))
    sums = joined.groupBy("source").agg(*taken)
    off = F.array(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    sums = sums.withColumnRenamed("source", "of")
    return cut(rates.join(sums, rates.source.eqNullSafe(sums.of)).select("source", "source_size", "target", "rate", F.array_min(off)["seed"].alias("seed")))


def _with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    side = broadcast_if_small(by_source.withColumnRenamed("source", "of_source"), 256)
    return rows.join(side, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target and rate of its
    source, copies, and taken = copies * size.

    Null and wordless texts have size 0 and take nothing; a null source is a source, the last in
    order; rows without doc_id draw by their text; repeated rows draw alike. An empty table gives an
    empty table. Reruns agree, as coins depend on doc_id and the source's seed alone."""
    sized = cut(_sized(docs))
    rows = _with_source(sized, _rates(sized, weights, share, most)).withColumn("copies", _copies(F.col("rate"), F.col("draw"), F.col("seed")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each row as often as the plan says, with its own columns only."""
    rates = _rates(cut(_sized(docs)), weights, share, most).select(F.col("source").alias("s"), "rate", "seed")
    of, rate, seed, copy = fresh(docs, "of", "rate", "seed", "copy")
    side = broadcast_if_small(rates.select(F.col("s").alias(of), F.col("rate").alias(rate), F.col("seed").alias(seed)), 256)
    rows = docs.join(side, F.col("source").cast("string").eqNullSafe(F.col(of)))
    copies = _copies(F.col(rate), _draw(_doc_key(text_of())), F.col(seed)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


#: The same for DuckDB. Caps fill in the order of size per weight, so the level is the first one at which
#: the next source stays below its cap.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         sha256('{SALT}:' || coalesce(doc_id::VARCHAR, '~' || sha256(coalesce(text, '')))) AS draw
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS place
  FROM src WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
chosen AS (
  SELECT level FROM fill WHERE level * weight <= 2.0::DOUBLE * source_size ORDER BY place LIMIT 1),
target AS (
  SELECT source, source_size, CASE WHEN weight * level > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target
  FROM src, chosen),
rate AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM target),
drawn AS (
  SELECT z.doc_id, z.size, r.*, k.seed,
         floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(z.draw, k.seed * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized z JOIN rate r ON z.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range({SEEDS})) AS seed) k),
seeds AS (
  SELECT source, arg_min(seed, off) AS seed FROM (
    SELECT source, seed, (abs(sum(size * copies)::DOUBLE - max(target)), seed) AS off FROM drawn GROUP BY source, seed) GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * d.copies)::BIGINT AS taken
FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.seed = s.seed
"""
