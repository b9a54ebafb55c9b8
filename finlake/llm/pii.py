"""Personal data: fixed patterns, and identifiers that bootstrapped contexts lead to. DataFrame and SQL
functions only.

Seeds are the values that the fixed patterns find at the start of a word. The words before a seed are its
lexical pattern. In each round Spark scores the bipartite graph of patterns and the words that follow
them: a pattern's confidence for a kind is the share of its occurrences that a known instance of that kind
follows, weighted by score; a word's score is one minus the product of what its patterns leave in doubt.
Words that look like identifiers and score enough become instances of the next round, whose patterns are
followed in turn, until a round finds nothing new. An instance keeps the kind and the score with which it
was found; scores of patterns only grow, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, text_of
from .native import joined, matches, outside, placed

KINDS = ("email", "ip", "card", "phone")
#: Contexts are the one or two words before; a pattern needs SUPPORT distinct instances and CONFIDENCE;
#: a new instance needs SCORE.
SUPPORT = 4
CONFIDENCE = 0.7
SCORE = 0.7
#: Characters kept of what stands before a match: enough for the words of a context. A longer word is no
#: context word.
LEFT = 80
WORD = r"[^\x20\x09-\x0D]+"

# The kinds' patterns. Possessive, and begun only where a run begins or the last match
# ended, so that they take linear time; they match the same as without.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _holds(kind: Column, value: Column) -> Column:
    """What a match must fulfil."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.length(digits).between(12, 19) & F.expr("luhn_check(regexp_replace(value, '[^0-9]', ''))"))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def _marked(docs: DataFrame) -> DataFrame:
    """Each row's key (of its text), and for texts that can hold an identifier their matches and body."""
    text = text_of()
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), "phone": F.contains(text, F.lit("+"))}
    found = [matches(text, _PATTERNS[k], guards[k], LEFT).alias(k) for k in KINDS]
    return docs.select("doc_id", F.md5(text).alias("key"), *found, F.when(text.rlike("[0-9@]"), text).alias("body"))


def _two(one: Column, two: Column) -> Column:
    """The patterns of a place: the word before it, and the two words before it."""
    return F.filter(F.array(one, F.when(two.isNotNull() & one.isNotNull(), F.concat_ws(" ", two, one))), lambda p: p.isNotNull())


def _shaped(word: Column) -> Column:
    """Context words are compared in lower case with digits alike."""
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def _seeds(spans: DataFrame) -> DataFrame:
    """``(pattern, kind, value, n)``: how often spans that begin a word stand behind the words before them."""
    words = F.regexp_extract_all("left", F.lit(WORD), F.lit(0))
    whole = (F.col("start") == F.length("left")) | F.col("left").rlike(r"^[\x20\x09-\x0D]")  # else the first word may be cut
    at = spans.filter(F.col("left").rlike(r"[\x20\x09-\x0D]$")).withColumn("before", F.when(whole, words).otherwise(F.slice(words, F.lit(2), F.size(words))))
    one, two = F.try_element_at("before", F.lit(-1)), F.try_element_at("before", F.lit(-2))
    each = at.select(F.explode(_two(_shaped(one), _shaped(two))).alias("pattern"), "kind", F.lower("value").alias("value"), "copies")
    return each.groupBy("pattern", "kind", "value").agg(F.sum("copies").alias("n"))


def _words(bodies: DataFrame) -> DataFrame:
    """``(key, value, start, end, one, two)``: every word of the bodies with the words before it."""
    words = placed(bodies.select("key", matches(F.col("body"), WORD).alias("w")), {"word": "w"})
    turn = Window.partitionBy("key", "kind").orderBy("start")  # dealt out like the matches: no other shuffle
    return words.select("key", "value", "start", "end", _shaped(F.lag("value", 1).over(turn)).alias("one"), _shaped(F.lag("value", 2).over(turn)).alias("two"))


def _degrees(docs: DataFrame, able: DataFrame) -> DataFrame:
    """``(pattern, degree)``: how often a word follows each of the ``able`` patterns in all rows of ``docs``."""
    words = docs.select(F.regexp_extract_all(_shaped(text_of()), F.lit(WORD), F.lit(0)).alias("w"))
    upto = lambda first, less: F.slice("w", first, F.greatest(F.lit(0), F.size("w") - less))
    two = F.zip_with(upto(1, 2), upto(2, 2), lambda a, b: F.concat_ws(" ", a, b))
    each = words.select(F.explode(F.concat(upto(1, 1), two)).alias("pattern"))
    return each.join(broadcast_if_small(able, 64 + F.octet_length("pattern")), "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"))


def _weighted(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``rows`` with the number of ``copies`` of their text."""
    return rows.join(broadcast_if_small(many, 64), "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


#: A word that looks like an identifier: five characters or more with a digit or an at sign, cut at
#: quotes, brackets and closing punctuation.
_CORE = r"[A-Za-z0-9+][A-Za-z0-9@._+/#-]{3,}[A-Za-z0-9]"


def _learned(docs: DataFrame, bodies: DataFrame, many: DataFrame, base: DataFrame) -> DataFrame:
    """``(key, kind, value, start, end)`` of identifiers found by contexts, none of which overlaps a base span.
    Only ``bodies`` can hold one; how often a pattern stands is counted over all rows of ``docs``, and ``many``
    has the copies of texts that stand in several."""
    seeds = cut(_seeds(_weighted(base, many)))
    if seeds.isEmpty():
        return base.select("key", "kind", "value", "start", "end").limit(0)
    odd = _words(bodies).withColumn("core", F.regexp_extract("value", _CORE, 0)).filter(F.col("core").rlike("[0-9@]") & F.col("one").isNotNull())
    odd_words = cut(_weighted(odd, many))
    places = odd_words.withColumn("pattern", F.explode(_two(F.col("one"), F.col("two"))))
    met = places.groupBy("pattern", F.lower("core").alias("value")).agg(F.sum("copies").alias("n")).withColumn("stood", F.col("n"))
    sown = seeds.groupBy("pattern", "value").agg(F.sum("n").alias("n")).withColumn("stood", F.lit(0).cast("long"))
    # a seed's word is also a word that looks like an identifier: each edge counts once
    graph = cut(met.union(sown).groupBy("pattern", "value").agg(F.max("n").alias("n"), F.max("stood").alias("stood")))
    # a pattern of few words never reaches the support; ``least``: it stands at least as often as these words
    wide = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("stood").alias("least")).filter(F.col("values") >= SUPPORT)
    graph = cut(graph.join(wide, "pattern").select("pattern", "value", "n", "least"))
    known = cut(seeds.select("kind", "value").distinct().withColumn("score", F.lit(1.0)))
    degree = None
    while True:
        sums = graph.join(known, "value").groupBy("pattern", "kind").agg(F.round(F.sum(F.col("score") * F.col("n")), 6).alias("sum"), F.count(F.lit(1)).alias("support"), F.max("least").alias("least"))
        sums = cut(sums.filter((F.col("support") >= SUPPORT) & (F.col("sum") >= F.col("least") * CONFIDENCE)))
        # occurrences are counted once for each pattern that comes so far
        ahead = sums.select("pattern").distinct()
        ahead = cut(ahead if degree is None else ahead.join(degree, "pattern", "left_anti"))
        if not ahead.isEmpty():
            counted = ahead.join(_degrees(docs, ahead), "pattern", "left").select("pattern", F.coalesce("degree", F.lit(0)).alias("degree"))
            degree = cut(counted if degree is None else degree.union(counted))
        if degree is None:
            return base.select("key", "kind", "value", "start", "end").limit(0)
        scored = sums.join(degree.filter("degree > 0"), "pattern").withColumn("confidence", F.least(F.lit(1.0), F.col("sum") / F.col("degree")))
        accepted = cut(scored.filter(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
        values = graph.join(accepted, "pattern").groupBy("value", "kind").agg(F.round(1 - doubt, 9).alias("score")).filter(F.col("score") >= SCORE)
        best = values.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("kind"))).alias("b")).select("b.kind", "value", (-F.col("b.less")).alias("score"))
        new = cut(best.join(known.select("value").distinct(), "value", "left_anti").select("kind", "value", "score"))
        if new.isEmpty():
            break
        known = cut(known.union(new))
    names = known.select(F.col("kind").alias("known_kind"), F.col("value").alias("known_value"))
    found = places.join(accepted, "pattern").join(names, (F.lower("core") == F.col("known_value")) & (F.col("kind") == F.col("known_kind")))
    at = F.col("start") + F.instr("value", F.col("core")) - 1
    spans = found.select("key", "kind", F.col("core").alias("value"), at.alias("start"), (at + F.length("core")).alias("end")).distinct()
    return outside(spans, base)


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, base, more)``: (doc_id, key) of each row, the key null where the text has neither digit nor at
    sign, and the spans (key, kind, value, start, end) of the fixed patterns and of the contexts, once for each
    distinct text."""
    marked = cut(_marked(docs))
    texts = cut(marked.filter("body is not null").drop("doc_id").dropDuplicates(["key"]))
    base = cut(placed(texts, {k: k for k in KINDS}).filter(_holds(F.col("kind"), F.col("value"))))
    many = cut(marked.filter("body is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    more = cut(_learned(docs, texts.select("key", "body"), many, base))
    return marked.select("doc_id", F.when(F.col("body").isNotNull(), F.col("key")).alias("key")), base, more


def summary(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of the base spans, and all
    spans as text (code points, end exclusive).

    Null and empty texts have no spans: counts 0, the digest of the empty string, and an empty list. Equal
    texts are searched once and have equal spans; rows without doc_id are kept."""
    rows, base, more = find(docs)
    every = base.select("key", "kind", "start", "end", F.lit(True).alias("base")).union(more.select("key", "kind", "start", "end", F.lit(False)))
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    per_text = every.groupBy("key").agg(*counts, joined(every, list(KINDS), "base_spans", where=F.col("base")), joined(every, list(KINDS), "spans"))
    # rows that can hold no span are many, often of one text, and need no join
    out = rows.filter("key is not null").join(per_text, "key", "left").unionByName(rows.filter("key is null"), allowMissingColumns=True)
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
