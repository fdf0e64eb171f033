"""Joins: equi-join with a collision policy, bridge join, keyed lookup with a
"found" flag, and parent -> child cascades.

No join strategy is hard-coded.  Catalyst chooses broadcast only for a side
whose estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE
re-checks that with the measured shuffle size at run time; large sides stay
sort-merge joins, and AQE's skew-join handling splits a hot key's partition
across tasks instead of sending it to one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.operators.names import column, qualified, quote, split_guard


def _as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Sequence[str],
    right_keys: str | Sequence[str],
    how: str = "inner",
    on_collision: str = "error",
    right_prefix: str = "right_",
    guard: bool = False,
) -> DataFrame:
    """Join on differently named keys; both key columns are kept, left
    columns first.  Null keys never match.  ``guard`` keeps a hot key
    splittable when an input is already grouped by it (``names.split_guard``;
    that input is shuffled once more).

    Names present on both sides are a plan-time decision: ``"error"`` refuses
    the join, ``"prefix_right"`` renames the right side's copies to
    ``right_prefix + name`` before joining.
    """
    lk, rk = _as_list(left_keys), _as_list(right_keys)
    if len(lk) != len(rk):
        raise ValueError("left_keys and right_keys differ in length")
    out_right = {c: c for c in right.columns}
    shared = [c for c in right.columns if c in set(left.columns)]
    if shared:
        if on_collision == "error":
            raise ValueError(f"columns on both sides: {shared}; use on_collision='prefix_right'")
        if on_collision != "prefix_right":
            raise ValueError(f"unknown on_collision {on_collision!r}")
        out_right.update({c: right_prefix + c for c in shared})
        clash = [out_right[c] for c in shared if out_right[c] in left.columns or out_right[c] in right.columns]
        if clash:
            raise ValueError(f"prefixed names already exist: {clash}")
    # Dataset aliases keep the two sides apart even in a self-join, and
    # vanish in optimisation: no projection lands between the joins.
    cond = " AND ".join(f"{qualified('__l', a)} = {qualified('__r', b)}" for a, b in zip(lk, rk))
    if guard:
        cond += f" AND {split_guard('__l', lk)} = {split_guard('__r', rk)}"
    joined = left.alias("__l").join(right.alias("__r"), on=F.expr(cond), how=how)
    left_out = [f"{qualified('__l', c)} AS {quote(c)}" for c in left.columns]
    if how.replace("_", "").lower() in ("semi", "leftsemi", "anti", "leftanti"):
        return joined.selectExpr(*left_out)  # no right-side columns
    return joined.selectExpr(
        *left_out,
        *[f"{qualified('__r', c)} AS {quote(out_right[c])}" for c in right.columns],
    )


def bridge_join(
    orgs: DataFrame,
    persons: DataFrame,
    memberships: DataFrame,
    person_key: str,
    membership_person_key: str,
    org_key: str,
    membership_org_key: str,
    drop_keys: Sequence[str] | None = None,
    first: str = "persons",
) -> DataFrame:
    """``orgs ⋈ (persons ⋈ memberships)`` through a bridge table.

    Persons join memberships on ``person_key = membership_person_key``, orgs
    join on ``org_key = membership_org_key``.  By default the membership's
    person key and the org key are dropped (each duplicates the key kept
    from the other side).  Columns: orgs, persons, memberships.

    Both joins are inner, so their order does not change the result;
    ``first`` says which side meets the bridge table first.  When neither
    side can be broadcast, the second join shuffles the first one's output
    again, so the narrower side should go first.
    """
    if first == "orgs":
        inner = equi_join(memberships, orgs, membership_org_key, org_key)
        joined = equi_join(persons, inner, person_key, membership_person_key)
    elif first == "persons":
        inner = equi_join(persons, memberships, person_key, membership_person_key)
        joined = equi_join(inner, orgs, membership_org_key, org_key)
    else:
        raise ValueError(f"first must be 'orgs' or 'persons', got {first!r}")
    ordered = [*orgs.columns, *persons.columns, *memberships.columns]
    drop = {membership_person_key, org_key} if drop_keys is None else set(drop_keys)
    return joined.select(*[quote(c) for c in ordered if c not in drop])


def lookup_report(
    names: DataFrame,
    name_column: str,
    definitions: DataFrame,
    key_column: str,
    found_column: str = "found",
    names_are_small: bool = False,
) -> DataFrame:
    """Look every requested name up among the definitions.

    Each name row is kept (duplicates too) with the definition's columns, or
    nulls and ``found = false`` when there is none.  ``definitions`` must be
    unique per key (see ``quality.keep_last``).

    This is one left join that AQE can split when one name is hot, also
    over definitions that were just de-duplicated.  With ``names_are_small``
    (a list from a command line) the definitions are first reduced to the
    requested ones by a semi join against the distinct names; Spark
    broadcasts those if their size allows, and a large catalog is then
    streamed once instead of shuffled.
    """
    marker = "__tableflow_found"
    if names_are_small:
        wanted = names.select(F.col(quote(name_column)).alias("__wanted")).distinct()
        definitions_used = definitions.join(
            wanted, F.expr(f"{quote(key_column)} = `__wanted`"), "left_semi"
        )
    else:
        definitions_used = definitions
    defs = definitions_used.withColumn(marker, F.lit(True))
    guard = f"{split_guard('__n', [name_column])} = {split_guard('__d', [key_column])}"
    cond = F.expr(f"{qualified('__n', name_column)} = {qualified('__d', key_column)} AND {guard}")
    joined = names.alias("__n").join(defs.alias("__d"), cond, "left")
    return joined.selectExpr(
        *[f"{qualified('__n', c)} AS {quote(c)}" for c in names.columns],
        f"coalesce({qualified('__d', marker)}, false) AS {quote(found_column)}",
        *[f"{qualified('__d', c)} AS {quote(c)}" for c in definitions.columns],
    )


def cascade_filter(
    parent: DataFrame, child: DataFrame, on: Mapping[str, str] | str
) -> DataFrame:
    """Children whose parent survives: a left-semi join.

    ``on`` maps child columns to parent columns (a single name means the same
    name on both sides).  Only the parent's key columns are read, so the
    shuffled side is small, and a semi join never duplicates children.
    """
    pairs = {on: on} if isinstance(on, str) else dict(on)
    keys = parent.select(*[column(parent, p).alias(f"__parent_{i}") for i, p in enumerate(pairs.values())])
    cond = [column(child, c) == F.col(f"__parent_{i}") for i, c in enumerate(pairs)]
    return child.join(keys, on=cond, how="left_semi")


def cascade_chain(
    levels: Sequence[DataFrame], links: Sequence[Mapping[str, str] | str]
) -> list[DataFrame]:
    """Apply ``cascade_filter`` down a hierarchy (database -> table ->
    partition): ``links[i]`` joins ``levels[i + 1]`` to the surviving
    ``levels[i]``.  Returns the surviving frame of every level."""
    if len(links) != len(levels) - 1:
        raise ValueError("need one link between each pair of levels")
    out = [levels[0]]
    for child, link in zip(levels[1:], links):
        out.append(cascade_filter(out[-1], child, link))
    return out
