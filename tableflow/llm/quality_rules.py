"""Quality rules with adaptive thresholds [native DataFrame functions].

Every document gets a handful of measures.  For each of them a mergeable
quantile sketch is kept per (language, source): a DDSketch, that is counts of
logarithmic buckets, so a sketch is a small group of rows and two sketches
merge by adding counts.  The sketches of a language's sources merge to the
language's, those of all languages to the corpus's.  A rule's threshold for a
(language, source) is

    median + SPREAD * max(p75 - median, FLOOR)

taken from the finest of the three levels that holds `MIN_GROUP` documents.
The thresholds are joined to the measures and a document is kept when the
base rule and every adaptive rule let it pass.

Edge cases: a null text has no words, so the base rule rejects it.  Null
languages and sources form groups of their own.  Rows that repeat or share a
doc_id are judged each for itself, and each gives a row.  An empty table gives
no rows.  Only doc_id, text, lang and source are read; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import let, materialize, word_list

#: Relative accuracy of a sketch's quantiles.
ACCURACY = 0.01
#: A (language, source) or language with fewer documents takes the next level's thresholds.
MIN_GROUP = 30
#: Documents of fewer words, or with a larger share of repeated words, fail the base rule.
BASE_WORDS, BASE_REPEAT_PCT = 50, 50

#: measure -> (numerator, denominator, spread, floor).  The floors keep a group
#: whose documents are all alike from rejecting the first one that differs.
RULES = {
    "symbol_ratio": ("n_symbols", "n_words", 8.0, 0.02),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 8.0, 0.05),
    "repeat_ratio": ("n_repeat_words", "n_words", 8.0, 0.05),
    "upper_ratio": ("n_upper", "word_chars", 8.0, 0.05),
    "word_length": ("word_chars", "n_words", 8.0, 0.5),
}

_LOG_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
#: Ratios up to this count as zero.
_ZERO = 1e-6


def _repeat_words(words: Column) -> Column:
    """Words inside any 3-word window that the list holds twice or more.

    Windows are sorted by their 64-bit hash and position, which brings equal
    ones together; the marked positions, sorted again, give the covered length.
    """
    n = F.size(words)

    def of_sorted(s: Column) -> Column:
        twin = F.filter(F.sequence(F.lit(0), n - 4), lambda k: s[k]["h"] == s[k + 1]["h"])
        marked = let(twin, lambda t: F.array_union(F.transform(t, lambda k: s[k]["at"]), F.transform(t, lambda k: s[k + 1]["at"])))
        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        )
        return let(F.array_sort(marked), covered)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]).alias("h"), i.alias("at")))

    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(F.sort_array(windows(hashes)), of_sorted)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts every rule is made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", "lang", "source", text.alias("text"))
        .withColumn("words", word_list(F.col("text")))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        .select(
            "doc_id",
            "lang",
            "source",
            F.size("words").cast("bigint").alias("n_words"),
            (F.char_length("text") - F.regexp_count("text", F.lit("[\\x20\\x09-\\x0D]"))).cast("bigint").alias("word_chars"),
            F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            F.regexp_count("text", F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
            _repeat_words(F.col("words")).alias("n_repeat_words"),
        )
    )


def _ratio(name: str) -> Column:
    numerator, denominator, *_ = RULES[name]
    return F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)).otherwise(F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one DDSketch per language, source
    and measure.  Sketches of several inputs merge by summing n."""
    long = measured.select("lang", "source", F.explode(F.create_map(*[x for m in RULES for x in (F.lit(m), _ratio(m))])).alias("measure", "value"))
    bucket = F.when(F.col("value") > _ZERO, F.ceil(F.log("value") / F.lit(_LOG_GAMMA))).otherwise(F.lit(-(10**6))).cast("bigint")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _value(bucket: Column) -> Column:
    """The middle of a bucket, within ACCURACY of every value in it."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    return F.when(bucket <= -(10**6), F.lit(0.0)).otherwise(2 * F.exp(bucket * F.lit(_LOG_GAMMA)) / F.lit(gamma + 1))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., measure, n_docs, p50, p75 of merged sketches.  A sketch has at
    most a few thousand buckets, whatever it counts."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    lists = merged.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("n_docs"))

    def quantile(q: float) -> Column:
        rank = F.floor(F.lit(q) * (F.col("n_docs") - 1)) + 1
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("bucket"))
        found = F.aggregate(
            "b",
            start,
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bucket"].isNull() & (a["seen"] + x["n"] >= rank), x["bucket"]).otherwise(a["bucket"]).alias("bucket")),
        )["bucket"]
        return _value(found)

    return lists.select(*keys, "measure", "n_docs", quantile(0.5).alias("p50"), quantile(0.75).alias("p75"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with an upper bound `max_<measure>` each."""
    fine, coarse, whole = (_quantiles(sketch, k) for k in (["lang", "source"], ["lang"], []))
    bounds = F.create_map(*[x for m, (_, _, s, f) in RULES.items() for x in (F.lit(m), F.array(F.lit(s), F.lit(f)))])

    def bound(q: DataFrame, name: str) -> DataFrame:
        rule = bounds[F.col("measure")]
        cut = F.col("p50") + rule[0] * F.greatest(F.col("p75") - F.col("p50"), rule[1])
        return q.withColumn(name, F.when(F.col("n_docs") >= min_group, cut)).drop("n_docs", "p50", "p75")

    whole = whole.withColumn("n_docs", F.lit(min_group))  # the last level always decides
    f, c, w = bound(fine, "f").alias("f"), bound(coarse, "c").alias("c"), bound(whole, "w").alias("w")
    joined = f.join(c, (F.col("f.measure") == F.col("c.measure")) & F.col("f.lang").eqNullSafe(F.col("c.lang"))).join(w, F.col("f.measure") == F.col("w.measure"))
    flat = joined.select("f.lang", "f.source", "f.measure", F.coalesce("f", "c", "w").alias("cut"))
    return flat.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("cut"))).alias(f"max_{m}") for m in RULES])


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Measures, thresholds and verdict per document (see the module)."""
    measured = materialize(measures(docs), "quality-measures")
    cuts = materialize(thresholds(sketches(measured), min_group), "quality-thresholds")
    base_failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PCT * F.col("n_words"))
    m, t = measured.alias("m"), cuts.alias("t")
    joined = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")))
    failed = F.array_compact(F.array(*[F.when(_ratio(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES]))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(failed) == 0)).alias("kept"),
        failed.alias("failed_rules"),
    )
