"""Mixing sources to target weights by weighted fair queueing.

Every source has a weight, and the sources share a budget of words in
proportion to their weights; none may give more than `repeats` times its own
words, and what it cannot give is shared again by weight among the others.

Each source's documents queue in a shuffled order (by a keyed hash, so reruns
agree), and the queue is read again from its head up to `repeats` times.  A
document enters as packets of at most `PACKET` words, so a long document does
not hold up its source.  A packet's virtual finish time is the source's words
up to its end, divided by the source's target: all sources reach time 1 with
their targets served.  The packets of all sources are range-sorted by finish
time and truncated at the budget; the packet that the budget's end falls into
is cut there.  So the mix has the budget's words exactly, and each source has
its target but for a few packets, whatever its number of documents.

No source is one task: its queue is cut into ranges of the hash with some
`RANGE` rows each, summed range by range.  Rows that repeat in full are counted
before they are shuffled and queue behind each other.

Edge cases: a null text has no words, and a document without words is never
taken.  Null is a source of its own, the last.  Null doc_ids, and rows that
share one, are documents of their own.  Where no text has words, every target
is 0.  A budget above `repeats` times all words takes all of them.  An empty
table gives no rows.  Only doc_id, source and text are read, whatever the other
columns are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import SPACE_RUN, materialize
from tableflow.llm.sharding import number_rows

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, "mix"
PACKET, RANGE = 512, 4096

#: [^\x20\x09-\x0D]+, a word, as a Java pattern.
_WORD = SPACE_RUN.replace("[", "[^", 1)


@dataclass(frozen=True)
class Mix:
    """queue: one row per document, with its place (`start`) in its source's
    queue; stream: the packets taken, in global order."""

    sources: DataFrame
    queue: DataFrame
    stream: DataFrame


def _units(docs: DataFrame, seed: str) -> DataFrame:
    """source, doc_id, key, size and copies of every different row."""
    text = F.coalesce(F.col("text"), F.lit("-"))
    own = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest")).cast("binary"))
    counted = own.groupBy("source", "doc_id", "size", "digest").agg(F.count("*").alias("copies"))
    return counted.select("source", "doc_id", "size", key.alias("key"), "copies")


def source_targets(sizes: DataFrame, budget: int | None, weights: Sequence[int], repeats: int) -> DataFrame:
    """sizes (source, source_size, rows) with sid (rank of the source by code
    point, null last), weight and target."""
    numbered = number_rows(sizes, F.col("source").asc_nulls_last()).withColumnRenamed("row_number", "sid")
    by_rank = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = materialize(numbered.withColumn("weight", by_rank), "mix-sources")
    most = F.col("source_size") * repeats
    if budget is None:
        budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:  # every round but the last finds one more source that is full
        over = most < F.lit(share) * F.col("weight")
        held = ranked.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, most)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if held["n"] == full or not held["open"]:
            break
        share, full = (budget - (held["given"] or 0)) / held["open"], held["n"]
    return ranked.withColumn("target", F.least(most.cast("double"), F.lit(share) * F.col("weight")))


def _queued(units: DataFrame, sources: DataFrame) -> DataFrame:
    """The units with the place of their first copy in their source's queue."""
    named = sources.select(F.col("source").alias("of"), "sid", F.ceil(F.col("rows") / RANGE).alias("ranges"))
    placed = units.join(named, F.col("source").eqNullSafe(F.col("of")))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    placed = placed.withColumn("part", F.shiftright(number * F.col("ranges"), 32))
    own = F.col("size") * F.col("copies")
    upto = F.sum(own).over(Window.partitionBy("sid", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = materialize(placed.select("sid", "part", "doc_id", "size", "copies", (upto - own).alias("inner"), own.alias("words")), "mix-queue")
    ranges = inner.groupBy("sid", "part").agg(F.sum("words").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("sid", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return inner.join(ranges, ["sid", "part"]).select("sid", "doc_id", "size", "copies", (F.col("before") + F.col("inner")).alias("first"))


def _truncated(packets: DataFrame, budget: int) -> DataFrame:
    """The packets in order of their finish times, up to `budget` words."""
    bits = 33  # monotonically_increasing_id: partition above, row in it below
    order = ["finish", "sid", "end"]
    rows = materialize(packets.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "mix-packets")
    part = F.shiftright("at", bits)
    sums = rows.groupBy(part.alias("part")).agg(F.sum("words").alias("sum"))
    upto = sums.withColumn("upto", F.sum("sum").over(Window.orderBy("part")))  # a row per partition
    last = upto.where(F.col("upto") >= budget).orderBy("part").first()
    if last is None:
        return rows
    whole = rows.where(part < last["part"])
    running = F.sum("words").over(Window.orderBy("at")) - F.col("words") + (last["upto"] - last["sum"])
    edge = rows.where(part == last["part"]).withColumn("before", running).where(F.col("before") < budget)
    return whole.union(edge.withColumn("words", F.least("words", F.lit(budget) - F.col("before"))).drop("before"))


def mix(docs: DataFrame, budget: int | None = None, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, packet: int = PACKET, seed: str = SEED) -> Mix:
    """The mix of `budget` words (all words of docs, if none is given)."""
    units = materialize(_units(docs, seed), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows"))
    sources = materialize(source_targets(sizes, budget, weights, repeats), "mix-targets")
    queued = _queued(units, sources)
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1), lambda k: F.col("first") + k * F.col("size"))
    queue = materialize(queued.select("sid", "doc_id", "size", F.explode(places).alias("start")), "mix-documents")

    # One pass more than the target needs: a mix may run a little beyond time 1.
    lengths = sources.where("target > 0").select("sid", "source_size", "target", F.least(F.lit(repeats), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int").alias("rounds"))
    cut = queue.where("size > 0").join(lengths, "sid")
    cut = cut.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    cut = cut.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(packet).cast("bigint"))))
    words = F.least(F.lit(packet).cast("bigint"), F.col("size") - F.col("first"))
    end = F.col("round") * F.col("source_size") + F.col("start") + F.col("first") + words
    packets = cut.select("sid", "start", "round", "first", words.alias("words"), end.alias("end"), (end / F.col("target")).alias("finish"))
    total = sources.agg(F.sum("source_size").alias("all"), F.sum("target").alias("target")).first()
    wanted = (total["all"] if budget is None else budget) or 0
    return Mix(sources, queue, _truncated(packets, min(wanted, repeats * (total["all"] or 0))))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix in its order: at, doc_id, source, round, first (word of the
    document that the packet begins with, from 0), words, finish."""
    made = mix(docs, **options)
    named = made.stream.join(made.queue.where("size > 0").select("sid", "start", "doc_id"), ["sid", "start"])
    return named.join(made.sources.select("sid", "source"), "sid").select("at", "doc_id", "source", "round", "first", "words", "finish")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    made = mix(docs, **options)
    taken = made.stream.groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    # A document without words shares its start with the next one, not its packets.
    joined = made.queue.join(taken, ["sid", "start"], "left").join(made.sources.select("sid", "source_size", "target"), "sid")
    return joined.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint").alias("taken"))
