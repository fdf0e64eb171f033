"""Source mixing against a plain-Python queue."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableflow.llm import mixing
from tests.llm import brute, edge

SCHEMA = "doc_id bigint, text string, source string"


def targets(sizes, weights=(1, 2, 3), repeats=3, budget=None):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = sum(sizes.values()) if budget is None else budget, {}, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if repeats * sizes[s] < share * weight[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in full}
        left, open_ = left - sum(out[s] for s in full), open_ - full
    return out


def expected(rows, packet, **options):
    """taken by (source, doc_id, text), summed over rows that repeat."""
    size = lambda t: len(brute.words(t))
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += size(t)
    goal = targets(sizes, **options)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda r: (md5(f"{mixing.SEED}:{'-' if r[0] is None else r[0]}:{md5('-' if r[1] is None else r[1])}"), size(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    packets = []
    for sid, s in enumerate(names):
        at, own = 0, sorted((r for r in rows if r[2] == s), key=key)
        for turn in range(3 if goal[s] else 0):
            at = turn * sizes[s]
            for r in own:
                for first in range(0, size(r[1]), packet):
                    n = min(packet, size(r[1]) - first)
                    packets.append(((at + first + n) / goal[s], sid, at + first + n, n, r))
                at += size(r[1])
    budget = min(sum(sizes.values()) if options.get("budget") is None else options["budget"], 3 * sum(sizes.values()))
    taken = Counter()
    for _, _, _, n, r in sorted(packets, key=lambda p: p[:3]):
        taken[r[2], r[0], r[1]] += min(n, budget)
        budget -= min(n, budget)
    return goal, sizes, taken


def check(spark, rows, packet, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    goal, sizes, want = expected(rows, packet, **options)
    made = mixing.mix(df, packet=packet, **options)
    assert {r.source: r.target for r in made.sources.collect()} == pytest.approx(goal)
    report = mixing.mix_report(df, packet=packet, **options).collect()
    assert len(report) == len(rows)
    got = Counter()
    for r in report:
        assert 0 <= r.taken <= 3 * r.size
        got[r.doc_id, r.size] += r.taken
    plain = Counter()
    for (s, i, t), n in want.items():
        plain[i, len(brute.words(t))] += n
    assert +got == +plain
    return goal, sizes, report


def rows_of(n, sources):
    return [(i, edge.prose(i, 5 + i * 7 % 90), sources[i % len(sources)]) for i in range(n)]


@pytest.mark.parametrize("budget", [None, 500, 10**9])
def test_equals_the_plain_queue(spark, budget):
    rows = rows_of(90, ["a", "b", "b", "b", "b", "c", "é", None, "d"]) + [(500, None, "a"), (501, " ", "e"), (None, "x y z", "e"), (None, "x y z", "e"), (None, "x y z", "e")]
    goal, sizes, report = check(spark, rows, 16, budget=budget)
    assert sum(r.taken for r in report) == min(sum(sizes.values()) if budget is None else budget, 3 * sum(sizes.values()))


def test_ranges_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)
    goal, sizes, report = check(spark, rows_of(120, ["hot", "hot", "hot", "cold"]), 32)


def test_sources_come_near_their_targets(spark):
    rows = rows_of(300, [f"s{k}" for k in range(7)]) + [(1000, edge.prose(1, 9000), "s0")]
    made = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    took = {r.source: r.n for r in made.stream.join(made.sources, "sid").groupBy("source").agg(F.sum("words").alias("n")).collect()}
    for r in made.sources.collect():
        assert abs(took[r.source] - r.target) <= 2 * mixing.PACKET


def test_the_mix_is_in_order_and_whole(spark):
    rows = rows_of(60, ["a", "b", "c"])
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixture(df, packet=10).orderBy("at").collect()
    assert [r.finish for r in out] == sorted(r.finish for r in out)
    assert sum(r.words for r in out) == sum(len(brute.words(t)) for _, t, _ in rows)
    assert mixing.mixture(df, packet=10).orderBy("at").collect() == out  # reruns agree
    assert mixing.mixture(df, packet=10, seed="other").orderBy("at").collect() != out


def test_edges_and_clashing_names(spark):
    docs = edge.docs(spark).select("*", *[F.lit(7).alias(c) for c in ("sid", "size", "copies", "a.b", "start", "words", "key", "digest", "part")])
    assert mixing.mix_report(docs).count() == len(edge.rows())
    assert mixing.mix_report(edge.none(spark)).count() == 0
    assert [r.taken for r in mixing.mix_report(spark.createDataFrame([(1, "", "a"), (2, None, None)], SCHEMA)).collect()] == [0, 0]
