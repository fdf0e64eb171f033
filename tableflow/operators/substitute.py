"""Placeholder substitution from a mapping table of any size.

``functions.text.substitute`` folds a short list of pairs over a text.  Here the
pairs are rows: the placeholders that a text holds are cut out of it and joined
to the mapping by shuffle, so no task and not the driver ever holds the mapping.

The result is that of the ordered fold (pair by pair, every occurrence, a later
pair sees what earlier ones made).  A text is *closed* if no replacement can
make a placeholder that was not there: none of its values holds a bracket, and
outside its placeholders it has no bracket either.  In a closed text all pairs
apply side by side.  Open texts are folded in rounds: each round applies, to
every open text, the earliest pair behind the last one applied whose placeholder
is there, until no text has one.  There are as many rounds as the text with the
most pairs applied needs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.operators.names import quote
from tableflow.session import scratch_path


#: Placeholders looked at for how common they are, rows that make one common,
#: and most pairs of common ones that are broadcast.
LISTED, COMMON, BROADCAST = 1000, 1 << 16, 10_000


def _keep(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def _check(mapping: DataFrame, pattern: str) -> None:
    whole = F.coalesce(F.col("placeholder").rlike(f"\\A{pattern}\\z"), F.lit(False))
    bad = mapping.where(~whole | F.col("value").isNull() | F.col("ordinal").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"not a bracketed placeholder, or no value or ordinal: {bad[0]}")


def _matches(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The inner join of both on ``placeholder``.  One that stands in many texts
    is a hot key, and so well compressed that AQE sees no skew: the rows of the
    most common ones meet their pairs by broadcast (and go if there are none),
    in the tasks that they are in."""
    asked = _keep(asked, "asked-placeholders")
    top = asked.agg(F.expr(f"approx_top_k(placeholder, {LISTED}, {10 * LISTED})").alias("top")).first().top or []
    hot = [t["item"] for t in top if t["item"] is not None and t["count"] >= COMMON]
    if not hot:
        return asked.join(pairs, "placeholder")
    common = F.col("placeholder").isin(hot)
    theirs = _keep(pairs.where(common), "common-pairs")
    if theirs.limit(BROADCAST + 1).count() <= BROADCAST:
        theirs = F.broadcast(theirs)
    return asked.where(~common).join(pairs, "placeholder").unionByName(asked.where(common).join(theirs, "placeholder"))


def substitute_from_table(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    opening: str = "{",
    closing: str = "}",
) -> DataFrame:
    """``df`` with the placeholders in ``column`` replaced by ``mapping``
    (``placeholder``, ``value``, ``ordinal``: its place in the order).

    Placeholders are bracketed texts without brackets inside, such as
    ``{job.name}``; others are refused.  Of pairs for one placeholder the
    earliest meets it first.  Null texts stay null.  The rows are written once
    to the scratch folder, to give each a number."""
    a, z = re.escape(opening), re.escape(closing)
    pattern = f"{a}[^{a}{z}]*{z}"
    mapping = mapping.select("placeholder", "value", "ordinal")
    _check(mapping, pattern)
    rows = _keep(df.select(*[F.col(quote(c)).alias(f"c{i}") for i, c in enumerate(df.columns)], F.monotonically_increasing_id().alias("id")), "substitute")
    text = F.col(f"c{df.columns.index(column)}")

    first = mapping.groupBy("placeholder").agg(F.min(F.struct("ordinal", "value")).alias("pair"))
    asked = rows.select("id", F.explode(_tokens(text, pattern)).alias("placeholder"))
    hits = _matches(asked, _keep(first.select("placeholder", F.col("pair.value").alias("value")), "first-pairs"))
    brackets = f"[{a}{z}]"
    found = hits.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("values"),
        F.max(F.col("value").rlike(brackets)).alias("feeds"),
    )
    closed = ~F.regexp_replace(text, pattern, "").rlike(brackets)
    joined = _keep(rows.join(found, "id", "left").withColumn("open", F.col("values").isNotNull() & (F.col("feeds") | ~closed)), "substituted")

    between = F.split(text, pattern, -1)
    tokens = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    filled = F.transform(tokens, lambda t: F.coalesce(F.col("values")[t], t))
    # Texts and placeholders by turns; the last text stands alone.
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), filled.alias("t")), lambda x: F.array(x["b"], F.coalesce(x["t"], F.lit(""))))), "")
    side_by_side = F.when(F.col("values").isNull(), text).otherwise(woven)

    folded = _fold(joined.where("open").select("id", text.alias("text")), mapping, pattern)
    out = [(F.col("text") if c == column else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)]
    if folded is None:
        return joined.withColumn("text", side_by_side).select(*out)
    # Only the open rows are joined again.
    done = folded.select(F.col("id").alias("done"), F.col("text").alias("folded"))
    opened = joined.where("open").join(done, F.col("id") == F.col("done"), "left").withColumn("text", F.col("folded"))
    return joined.where("not open").withColumn("text", side_by_side).select(*out).union(opened.select(*out))


def _fold(texts: DataFrame, mapping: DataFrame, pattern: str) -> DataFrame | None:
    """id, text after all pairs in order; None if there are no texts."""
    now = _keep(texts.withColumn("last", F.lit(None).cast(dict(mapping.dtypes)["ordinal"])), "open-texts")
    if now.isEmpty():
        return None
    finished: DataFrame | None = None
    while True:
        asked = now.select("id", "last", F.explode(_tokens(F.col("text"), pattern)).alias("placeholder"))
        later = _matches(asked, mapping).where(F.col("last").isNull() | (F.col("ordinal") > F.col("last")))
        pairs = later.groupBy("id").agg(F.min(F.struct("ordinal", "placeholder", "value")).alias("pair"))
        step = _keep(now.join(pairs, "id", "left"), "folded-texts")
        rest = step.where("pair is null").select("id", "text")
        finished = rest if finished is None else finished.union(rest)
        moved = step.where("pair is not null")
        if moved.isEmpty():
            return finished
        now = moved.select("id", F.replace("text", F.col("pair.placeholder"), F.col("pair.value")).alias("text"), F.col("pair.ordinal").alias("last"))
