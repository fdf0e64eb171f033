"""Cascades down a hierarchy of any depth, from parent links.

``joins.cascade_chain`` knows its levels; here a table of (key, parent) links
holds them all, however deep.  Links are followed by pointer doubling: each
round every key learns the link of the key that it points to, so a chain of
depth n takes log2(n) rounds of one join each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.operators.names import column as column_of
from tableflow.operators.names import quote
from tableflow.session import scratch_path

#: Why a row does not survive, in the order in which it is told.
DUPLICATE, CYCLE, ORPHAN, SKIPPED = "duplicate key", "cycle", "no such parent", "skipped ancestor"


def _keep(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cascade_tree(
    df: DataFrame,
    key: str,
    parent: str,
    skipped: str | None = None,
    reason_column: str = "reason",
    depth_column: str = "depth",
    root_column: str = "root",
) -> DataFrame:
    """``df`` with the depth of each row (0 for a root, whose parent is null),
    its root's key, and why it does not survive (null: it does).

    A row survives if its line of parents reaches a root and no row on it, the
    row itself included, has the boolean ``skipped`` set.  Rows whose line ends
    at a key that is not there, or runs in a circle, have neither depth nor
    root.  Rows without a key are roots or orphans of their own; rows that share
    a key are refused as parents of anybody (``duplicate key`` for them and all
    below), as nothing says which of them is meant.

    Only keys and links are shuffled, ceil(log2(depth)) + 1 times; a parent that
    many rows point to is a hot key of a join that AQE can split."""
    skip = F.coalesce(column_of(df, skipped).cast("boolean"), F.lit(False)) if skipped else F.lit(False)
    links = df.select(column_of(df, key).alias("k"), column_of(df, parent).alias("p"), skip.alias("s")).where("k is not null")
    nodes = links.groupBy("k").agg(F.first("p").alias("p"), F.bool_or("s").alias("s"), (F.count(F.lit(1)) > 1).alias("twice"))
    # up: the key that the steps so far lead to, null behind a root; steps: how
    # many they were; last: the last key met.  Cut: the line leaves the table.
    known = nodes.select(F.col("k").alias("known"))
    state = nodes.join(known, F.col("p") == F.col("known"), "left").select(
        "k",
        F.when(F.col("known").isNotNull() & ~F.col("twice"), F.col("p")).alias("up"),
        F.lit(1).cast("bigint").alias("steps"),
        F.col("k").alias("last"),
        (F.col("p").isNotNull() & F.col("known").isNull() & ~F.col("twice")).alias("cut"),
        "s",
        "twice",
    )
    state = _keep(state, "hierarchy")
    n = state.count()
    rounds = max(1, (n - 1).bit_length() + 1)
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        ahead = state.select(F.col("k").alias("at"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("last").alias("last2"), F.col("cut").alias("cut2"), F.col("s").alias("s2"), F.col("twice").alias("twice2"))
        joined = state.join(ahead, F.col("up") == F.col("at"), "left")
        more = F.col("at").isNotNull()
        state = _keep(
            joined.select(
                "k",
                F.col("up2").alias("up"),
                F.when(more, F.col("steps") + F.col("steps2")).otherwise(F.col("steps")).alias("steps"),
                F.coalesce("last2", "last").alias("last"),
                (F.col("cut") | F.coalesce("cut2", F.lit(False))).alias("cut"),
                (F.col("s") | F.coalesce("s2", F.lit(False))).alias("s"),
                (F.col("twice") | F.coalesce("twice2", F.lit(False))).alias("twice"),
            ),
            "hierarchy",
        )
    # What still points on after more steps than there are keys runs in a circle.
    reason = F.when(F.col("twice"), DUPLICATE).when(F.col("up").isNotNull(), CYCLE).when(F.col("cut"), ORPHAN).when(F.col("s"), SKIPPED)
    ends = ~F.col("twice") & F.col("up").isNull() & ~F.col("cut")
    verdict = state.select(F.col("k").alias("__key"), reason.alias("__reason"), F.when(ends, F.col("steps") - 1).alias("__depth"), F.when(ends, F.col("last")).alias("__root"))
    kept = [F.col(quote(c)) for c in df.columns]
    own = column_of(df, key)
    alone = F.when(column_of(df, parent).isNotNull(), F.lit(ORPHAN)).when(skip, F.lit(SKIPPED))
    joined = df.join(verdict, own == F.col("__key"), "left")
    return joined.select(
        *kept,
        F.when(own.isNull() & column_of(df, parent).isNull(), F.lit(0).cast("bigint")).otherwise(F.col("__depth")).alias(depth_column),
        F.col("__root").alias(root_column),
        F.when(own.isNull(), alone).otherwise(F.col("__reason")).alias(reason_column),
    )
