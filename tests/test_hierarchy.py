"""Cascade over parent links of any depth, against plain walking."""

import random

import pytest

from conftest import plan_text
from tableflow.operators import hierarchy
from tableflow.operators.hierarchy import cascade_tree

SCHEMA = "`k.y` bigint, up bigint, `no` boolean, tag int"


def _walk(rows):
    """(depth, root, reason) of each row."""
    nodes = {}
    for k, p, s, _ in rows:
        if k is not None:
            nodes.setdefault(k, []).append((p, bool(s)))
    out = []
    for k, p, s, _ in rows:
        if k is None:
            out.append((0 if p is None else None, None, "no such parent" if p is not None else "skipped ancestor" if s else None))
            continue
        at, seen, twice, skip, end = k, [], False, False, None
        while True:
            if at in seen:
                end = "cycle"
                break
            seen.append(at)
            if len(nodes[at]) > 1:
                twice = True
                break
            up, own = nodes[at][0]
            skip |= own
            if up is None:
                break
            if up not in nodes:
                end = "no such parent"
                break
            at = up
        reason = "duplicate key" if twice else end or ("skipped ancestor" if skip else None)
        out.append((len(seen) - 1, seen[-1], reason) if not twice and end is None else (None, None, reason))
    return out


def _check(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = cascade_tree(df, "k.y", "up", "no")
    assert got.columns == [*df.columns, "depth", "root", "reason"]
    rows = [(*r, i) for i, r in enumerate(rows)]
    assert {r.tag: (r.depth, r.root, r.reason) for r in got.collect()} == {i: w for i, w in enumerate(_walk(rows))}


@pytest.mark.parametrize("seed", range(3))
def test_equals_walking(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice([None, None, k // 2, r.randrange(40), 99]), r.random() < 0.1) for k in range(1, 40)]
    rows += [(None, None, False), (None, 3, True), (None, None, True), (5, 1, False), (50, 51, False), (51, 52, None), (52, 50, False), (53, 50, False), (60, 60, False)]
    _check(spark, rows)


def test_a_chain_of_a_thousand_in_logarithmic_rounds(spark, monkeypatch):
    rounds, keep = [], hierarchy._keep
    monkeypatch.setattr(hierarchy, "_keep", lambda df, name: rounds.append(name) or keep(df, name))
    rows = [(k, k - 1 if k else None, k == 500, k) for k in range(1000)]
    got = {r.tag: r for r in cascade_tree(spark.createDataFrame(rows, SCHEMA), "k.y", "up", "no").collect()}
    assert all(got[k].depth == k and got[k].root == 0 for k in range(1000))
    assert all((got[k].reason == "skipped ancestor") == (k >= 500) for k in range(1000))
    assert len(rounds) <= 12


def test_a_star_and_nothing(spark):
    _check(spark, [(0, None, False), *[(k, 0, False) for k in range(1, 300)]])
    assert cascade_tree(spark.createDataFrame([], SCHEMA), "k.y", "up").count() == 0


def test_plan_has_no_python_or_cross_join(spark):
    plan = plan_text(cascade_tree(spark.createDataFrame([(1, None, False, 1)], SCHEMA), "k.y", "up", "no"))
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
