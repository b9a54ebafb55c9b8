"""Non-equi joins re-expressed as equi-joins with exact residual checks.

* ``bank_invoice_match``: |amount difference| <= 1 cent becomes an equi-join on integer cents with
  the invoice side exploded to {c-1, c, c+1}; the text test (invoice number or supplier name inside
  the bank description) is the residual; the first invoice per transaction is a ``min_by``.
* ``duplicate_payment_pairs``: "earliest earlier payment with the same reference whose amount is
  within 10 %" is an exact range-minimum query over integer cents. The payments of a reference with few
  of them are compared in one array; the other references are answered with equi-joins on aligned
  power-of-two blocks (O(n log range), no pairs, robust to one key holding most rows).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import money_from_cents, out_money, reference_key


def _cents(amount: str) -> F.Column:
    # money is decimal(18,2): unscaled cents exactly
    return (F.abs(F.col(amount)) * 100).cast("bigint")


def bank_invoice_match(bank: DataFrame, invoices: DataFrame, tolerance_cents: int = 1, min_name: int = 4) -> DataFrame:
    """First invoice (by invoice id) per bank transaction with |amount diff| <= tolerance and the
    invoice number, or a supplier name of >= ``min_name`` characters, inside the description."""
    b = bank.select("company_id", F.col("id").alias("txn_id"), F.lower(F.coalesce("description", F.lit(""))).alias("desc"),
                    _cents("amount").alias("cents")).filter(F.col("cents") > 0)
    offsets = F.array(*[F.lit(d) for d in range(-tolerance_cents, tolerance_cents + 1)])
    i = (invoices.select("company_id", F.col("id").alias("invoice_id"), "invoice_number",
                         F.lower(F.coalesce("invoice_number", F.lit(""))).alias("num"),
                         F.lower(F.coalesce("supplier", F.lit(""))).alias("sup"),
                         _cents("amount").alias("ic"), F.explode(offsets).alias("off"))
         .withColumn("cents", F.col("ic") + F.col("off")).drop("ic", "off"))
    j = b.join(i, ["company_id", "cents"])
    ref = (F.col("num") != "") & F.col("desc").contains(F.col("num"))
    sup = (F.length("sup") >= min_name) & F.col("desc").contains(F.col("sup"))
    hit = j.filter(ref | sup)
    first = hit.groupBy("company_id", "txn_id").agg(
        F.min_by(F.struct("invoice_id", "invoice_number"), F.col("invoice_id")).alias("m"))
    return first.select("company_id", "txn_id", F.col("m.invoice_id").alias("invoice_id"),
                        F.col("m.invoice_number").alias("invoice_number"))


def bank_reconciliation_counts(bank: DataFrame, invoices: DataFrame, matches: DataFrame) -> DataFrame:
    bt = bank.groupBy("company_id").agg(F.count("*").alias("n_bank"))
    iv = invoices.groupBy("company_id").agg(F.count("*").cast("bigint").alias("invoice_records_considered"))
    mt = matches.groupBy("company_id").agg(F.count("*").alias("matched"),
                                           F.countDistinct("invoice_number").cast("bigint").alias("matched_invoices"))
    j = bt.join(iv, "company_id", "left").join(mt, "company_id", "left")
    matched = F.coalesce("matched", F.lit(0)).cast("bigint")
    return j.select("company_id", matched.alias("matched_bank_transactions"),
                    F.coalesce("matched_invoices", F.lit(0)).cast("bigint").alias("matched_invoices"),
                    F.greatest(F.lit(0), F.col("n_bank") - matched).cast("bigint").alias("unmatched_bank_transactions"),
                    F.coalesce("invoice_records_considered", F.lit(0)).cast("bigint").alias("invoice_records_considered"))


def _floor_log2(x: str) -> str:
    """floor(log2(x)) for a positive bigint SQL expression, corrected for floating rounding."""
    j = f"CAST(floor(log2({x})) AS INT)"
    return (f"(CASE WHEN shiftleft(CAST(1 AS BIGINT), {j}) > ({x}) THEN {j} - 1 "
            f"WHEN shiftleft(CAST(1 AS BIGINT), {j} + 1) <= ({x}) THEN {j} + 1 ELSE {j} END)")


def _dyadic_blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of ``df`` times the aligned power-of-two blocks (level, block) covering the integer
    interval [lo, hi] exactly: the bottom-up segment-tree walk in closed form. At level j, with
    l = ceil(lo / 2^j) and r = floor((hi + 1) / 2^j), block l is used when l < r and l is odd, block
    r - 1 when l < r and r is odd (at most two per level). Two generators and a filter: codegen'd,
    no per-row loop state."""
    top = _floor_log2(f"({hi}) + 1")
    lj = F.expr(f"shiftright(({lo}) + shiftleft(CAST(1 AS BIGINT), j) - 1, j)")
    rj = F.expr(f"shiftright(({hi}) + 1, j)")
    levels = df.select("*", F.explode(F.expr(f"sequence(0, {top})")).alias("j")).withColumns({"lj": lj, "rj": rj}) \
        .filter(F.col("lj") < F.col("rj"))
    both = levels.select(*df.columns, "j", F.explode(F.array(
        F.struct(F.col("lj").alias("block"), (F.pmod("lj", F.lit(2)) == 1).alias("ok")),
        F.struct((F.col("rj") - 1).alias("block"), (F.pmod("rj", F.lit(2)) == 1).alias("ok")))).alias("b"))
    return both.filter(F.col("b.ok")).select(*df.columns, F.col("j").alias("level"), F.col("b.block").alias("block"))


#: A reference with at most this many payments is compared within one array of them.
SMALL_GROUP = 64


def _range(c: str, p: int, q: int) -> tuple[str, str]:
    """The comparable amounts of ``c`` in cents, smallest and largest."""
    return f"(greatest({c}, 100) * {p} + {q - 1}) div {q}", f"({c} * {q}) div {p}"


def _first_in_group(t: DataFrame, p: int, q: int) -> DataFrame:
    """The first payment in each payment's range, from the array of its reference's payments."""
    lo, hi = _range("p.c", p, q)
    near = f"filter(g, e -> e.c >= {lo} AND e.c <= {hi})"
    groups = t.groupBy("h", "company_id", "k").agg(F.collect_set(F.struct("d", "id", "c")).alias("g"))
    each = groups.filter(F.size("g") > 1).select("company_id", "k", "g", F.explode("g").alias("p")).filter(F.col("p.c") * q >= 100 * p)
    first = F.expr(f"array_min(transform({near}, e -> struct(struct(e.d AS d, e.id AS id) AS f, e.c AS ec)))")
    return each.select("company_id", "k", "p.id", "p.d", "p.c", first.alias("m"))


def _first_in_range(t: DataFrame, p: int, q: int) -> DataFrame:
    """Exact range minimum over aligned power-of-two amount blocks, once for each amount of a reference."""
    k_factor = (q / p) * (q / p - p / q)  # a block a query can use has 2^j <= K * amount + 1
    firsts = t.groupBy("company_id", "k", "c").agg(F.min(F.struct("d", "id")).alias("f"))
    levels = F.expr(f"sequence(0, {_floor_log2(f'CAST(floor({k_factor!r} * c) AS BIGINT) + 1')} + 1)")
    blocks = (firsts.select("company_id", "k", "c", "f", F.explode(levels).alias("level"))
              .withColumn("block", F.expr("shiftright(c, level)"))
              .groupBy("company_id", "k", "level", "block")
              .agg(F.min(F.struct("f", F.col("c").alias("ec"))).alias("m")))
    lo, hi = _range("c", p, q)
    probes = _dyadic_blocks(firsts.filter(F.col("c") * q >= 100 * p).select("company_id", "k", "c"), lo, hi)
    best = probes.join(blocks, ["company_id", "k", "level", "block"]).groupBy("company_id", "k", "c").agg(F.min("m").alias("m"))
    return t.select("company_id", "k", "id", "d", "c").distinct().join(best, ["company_id", "k", "c"]).select("company_id", "k", "id", "d", "c", "m")


def duplicate_payment_pairs(txn: DataFrame, ratio: float = 0.9, compat_key: bool = False) -> DataFrame:
    """For each transaction with a positive amount, the earliest earlier transaction (order:
    date, id) with the same reference key and min / max(amounts, 1.00) >= ratio.

    Exact and skew-safe. In integer cents the comparable amounts of ``a`` form the interval
    [ceil(max(a, 100) p / q), floor(a q / p)] (ratio = p / q); the answer is the range minimum of
    "first occurrence" over the key's distinct amounts, compared with the transaction itself. Keys with
    at most ``SMALL_GROUP`` transactions are brought together in one shuffle. Of the other keys each
    distinct amount feeds the aligned power-of-two blocks that contain it, its interval splits into
    O(log width) blocks, and an equi-join on (company, key, level, block) gives the minimum --
    O(n log range) whatever a key's share of the rows, and no pair of its transactions is made. Keys are
    counted by a hash: keys that share one are at most counted as large, which gives the same rows."""
    frac = Fraction(ratio).limit_denominator(10_000)
    p, q = frac.numerator, frac.denominator
    t = (txn.select("company_id", "id", "transaction_date", "description", "amount")
         .select("company_id", "id", F.col("transaction_date").alias("d"),
                 reference_key(F.col("description"), compat_key).alias("k"), _cents("amount").alias("c"))
         .filter((F.col("k") != "") & (F.col("c") > 0) & F.col("company_id").isNotNull())
         .withColumn("h", F.xxhash64("company_id", "k")))
    large = t.groupBy("h").count().filter(F.col("count") > SMALL_GROUP).select("h")
    best = _first_in_group(t.join(large, "h", "left_anti"), p, q).unionByName(_first_in_range(t.join(large, "h", "left_semi"), p, q))
    out = best.filter(F.col("m.f") < F.struct(F.col("d"), F.col("id")))
    return out.select("company_id", F.col("k").alias("reference_key"), F.col("m.f.id").alias("earlier_id"),
                      out_money(money_from_cents(F.col("m.ec"))).alias("earlier_amount"), F.col("id").alias("current_id"),
                      out_money(money_from_cents(F.col("c"))).alias("current_amount"))
