"""Secrets: fixed patterns, and weak candidates that only count beside what completes them. DataFrame and
SQL functions only.

An access identifier, a secret and an endpoint make up a credential. Each has a weak form that alone
means nothing: a named user or client id, a long mixed string, a URL or host with a port. Parts are
joined as intervals: two parts meet if at most SCOPE characters of one text lie between them. A weak
secret is reported beside an identifier, a weak identifier beside a secret, and an endpoint beside both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .native import joined, matches, meeting, outside, placed

KINDS = ("assign", "access", "hex")
WEAK = ("ident", "secret", "endpoint")
#: Characters that may lie between the parts of one credential.
SCOPE = 200

# The kinds' patterns (possessive, where that matches the same).
_PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{24,}+",
}
_WEAK_PATTERNS = {
    "ident": r"""(?i:user(?:_?name|_?id)?|login|client_?id|access_?(?:key_?)?id|account_?id|tenant_?id)["']?\x20?[:=]\x20?["']?[A-Za-z0-9._@-]{3,}+""",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "endpoint": r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[^\x20\x09-\x0D"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++:[0-9]{2,5}+""",
}


def _holds(kind: Column, value: Column) -> Column:
    """What a match must fulfil."""
    given = F.regexp_extract(value, r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return F.when(kind == "assign", F.length(given) >= 6).when(kind == "access", F.length(value) >= 20).when(kind == "secret", mixed).otherwise(F.lit(True))


def _marked(docs: DataFrame) -> DataFrame:
    text = text_of()
    guards = {
        "assign": text.rlike(r"(?i:pass|secret|token|api)"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(_PATTERNS["hex"]),
        "ident": text.rlike(r"(?i:user|login|id)[a-zA-Z_]*+[\"']?\x20?[:=]"),
        "secret": text.rlike(r"[A-Za-z0-9+/_=-]{20}"),
        "endpoint": text.rlike(r"://|:[0-9]{2}"),
    }
    patterns = _PATTERNS | _WEAK_PATTERNS
    return docs.select("doc_id", F.md5(text).alias("key"), *[matches(text, patterns[k], guards[k]).alias(k) for k in patterns])


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, base, more)``: (doc_id, key) of each row, and the spans (key, kind, start, end) of the
    fixed patterns and of linked weak candidates, once for each distinct text."""
    marked = cut(_marked(docs))
    every = [*KINDS, *WEAK]
    some = F.greatest(*[F.size(F.coalesce(k, F.array().cast(marked.schema[k].dataType))) for k in every]) > 0
    texts = marked.filter(some).drop("doc_id").dropDuplicates(["key"])
    spans = cut(placed(texts, {k: k for k in every}).filter(_holds(F.col("kind"), F.col("value"))).select("key", "kind", "start", "end"))
    base = spans.filter(F.col("kind").isin(*KINDS))
    weak = cut(outside(spans.filter(F.col("kind").isin(*WEAK)), base))
    # inside a URL or host nothing else is a part
    endpoints = weak.filter("kind = 'endpoint'")
    inner = cut(outside(weak.filter("kind <> 'endpoint'"), endpoints))
    idents = inner.filter("kind = 'ident'").union(base.filter("kind = 'access'"))
    secrets = inner.filter("kind = 'secret'").union(base.filter("kind in ('assign', 'hex')"))
    more = meeting(inner.filter("kind = 'secret'"), idents, SCOPE).union(meeting(inner.filter("kind = 'ident'"), secrets, SCOPE))
    more = more.union(meeting(meeting(endpoints, idents, SCOPE), secrets, SCOPE))
    return marked.select("doc_id", "key"), base, more


def summary(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of the base spans, and all
    spans as text (code points, end exclusive).

    Null and empty texts have no spans: counts 0, the digest of the empty string, and an empty list. Equal
    texts are searched once and have equal spans; rows without doc_id are kept."""
    rows, base, more = find(docs)
    every = base.withColumn("base", F.lit(True)).union(more.withColumn("base", F.lit(False)))
    order = [*KINDS, *WEAK]
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    per_text = every.groupBy("key").agg(*counts, joined(every, order, "base_spans", where=F.col("base")), joined(every, order, "spans"))
    return rows.join(per_text, "key", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
