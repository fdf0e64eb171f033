"""Reconcile a source with a target: sync plan, upsert, insert-only, and
matching partitions by their value list.

Only key columns cross the shuffle where the other side's rows are not
needed (the target's keys in ``sync_plan``, the source's keys in the anti
joins), and no operator ever deletes a target row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.operators.joins import equi_join
from tableflow.operators.names import qualified, quote, split_guard
from tableflow.operators.quality import keep_last


def _as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def existing_keys(
    target: DataFrame, source: DataFrame, keys: Sequence[str], small_source: bool = False
) -> DataFrame:
    """Distinct target keys to join the source against.

    Default: the target's distinct keys (one pass over each side).  With ``small_source`` (an
    incremental batch against a large target) the target keys are first
    semi-joined with the source keys: the small side is broadcast when its
    size estimate allows, the target is only streamed, never shuffled, and
    the result has at most the source's key count.  That costs a second
    (key-only) read of the source, so it only pays for a small source.
    """
    target_keys = target.select(*map(quote, keys))
    if small_source:
        target_keys = target_keys.join(source.select(*map(quote, keys)), on=list(keys), how="left_semi")
    return target_keys.distinct()


def sync_plan(
    source: DataFrame,
    target: DataFrame,
    keys: str | Sequence[str],
    allow_overwrite: bool = True,
    action_column: str = "action",
    small_source: bool = False,
) -> DataFrame:
    """Source rows with the action a sync would take for each:
    ``create`` (key missing in target), ``overwrite`` (present and
    overwriting allowed) or ``keep``.  Nothing is ever deleted.

    This is also the dry run: it writes nothing.  Source keys should be
    unique (``keep_last``).  See ``existing_keys`` for ``small_source``.
    """
    key_cols = _as_list(keys)
    hit = "__tableflow_in_target"
    present = existing_keys(target, source, key_cols, small_source).withColumn(hit, F.lit(True))
    # The distinct keys are grouped by key already; the guard lets AQE split
    # a key that holds much of the source.
    same = " AND ".join(f"{qualified('__s', k)} = {qualified('__t', k)}" for k in key_cols)
    same += f" AND {split_guard('__s', key_cols)} = {split_guard('__t', key_cols)}"
    joined = source.alias("__s").join(present.alias("__t"), F.expr(same), "left")
    when_present = "'overwrite'" if allow_overwrite else "'keep'"
    return joined.selectExpr(
        *[f"{qualified('__s', c)} AS {quote(c)}" for c in source.columns],
        f"CASE WHEN {quote(hit)} IS NULL THEN 'create' ELSE {when_present} END AS {quote(action_column)}",
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str] | None = None,
    allow_missing_columns: bool = False,
) -> DataFrame:
    """Source rows replace whole target rows with the same key; target-only
    rows stay; source-only rows are added.

    Duplicate source keys would multiply rows, so with ``order_by`` the
    source is first reduced to its last row per key.  Write the result to a
    new location (reading and overwriting one path in one job is unsafe).
    """
    key_cols = _as_list(keys)
    # The raw source keys: the same set as the reduced source's, no window.
    kept = target.join(source.select(*map(quote, key_cols)), on=key_cols, how="left_anti").select(*map(quote, target.columns))
    if order_by is not None:
        source = keep_last(source, key_cols, order_by)
    return source.unionByName(kept, allowMissingColumns=allow_missing_columns)


def insert_missing(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str] | None = None,
    allow_missing_columns: bool = False,
    small_source: bool = False,
) -> DataFrame:
    """Insert-only upsert: existing target rows win, new source keys are
    added (see ``existing_keys`` for ``small_source``)."""
    key_cols = _as_list(keys)
    if order_by is not None:
        # Rows of known keys go before the reduction, which then has less to do.
        source = keep_last(source.join(target.select(*map(quote, key_cols)), on=key_cols, how="left_anti").select(*map(quote, source.columns)), key_cols, order_by)
        return target.unionByName(source, allowMissingColumns=allow_missing_columns)
    present = target.select(*map(quote, key_cols))  # an anti join needs no distinct keys
    if small_source:
        present = present.join(source.select(*map(quote, key_cols)), on=key_cols, how="left_semi")
    new = source.join(present, on=key_cols, how="left_anti").select(*map(quote, source.columns))
    return target.unionByName(new, allowMissingColumns=allow_missing_columns)


def partition_match(
    left: DataFrame,
    right: DataFrame,
    left_values: str,
    right_values: str | None = None,
    how: str = "inner",
    right_prefix: str = "right_",
) -> DataFrame:
    """Match rows whose partition value lists are equal: same values, same
    order (an equi-join on an array key, hashed like any other key).  The
    right side's value column is dropped; other names present on both sides
    get ``right_prefix`` on the right (see ``joins.equi_join``)."""
    rv = right_values or left_values
    joined = equi_join(left, right, left_values, rv, how=how,
                       on_collision="prefix_right", right_prefix=right_prefix, guard=True)
    return joined.drop(right_prefix + rv if rv in left.columns else rv)
