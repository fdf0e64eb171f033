"""Merkle manifest against a plain-Python tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tableflow.llm import merkle
from tests.llm import edge


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """(root, for each leaf its siblings and where it stands among them)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for i, k in enumerate(at):
            run, own = runs[k // 8], k % 8
            paths[i].append((run[:own], run[own + 1 :]))
        at, level = [k // 8 for k in at], [H(*run) for run in runs]
    return (level[0] if level else None), paths


def expected(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[lang] = own, *tree([leaf(r, r.text) for r in own])
    root, tops = tree([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            hit = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = leaf(r, r.text.translate(upper) if hit else r.text)
            steps = [*path, *top]
            for before, behind in steps:
                node = H(*before, node, *behind)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, H(*[x for a, b in steps for x in (*a, *b)]), node, node == root))
    return out


def results(df):
    got = merkle.verify_documents(df, merkle.damaged())
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=key), sorted(expected(df.collect()), key=key)


def test_edge_rows(spark):
    got, want = results(edge.docs(spark))
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 65, 600])
def test_sizes(spark, n):
    rows = [(i, f"Text {i}", None if i % 11 == 5 else ["en", "de", "é"][min(2, i % 13)], "s", i) for i in range(n)]
    got, want = results(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert got == want


def test_many_languages(spark):
    rows = [(i, "Text", f"lang{i // 2}", None, None) for i in range(150)]
    got, want = results(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert got == want


def test_one_language_with_one_row_and_none(spark):
    assert results(edge.none(spark)) == ([], [])


def test_intervals_nest(spark):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made = merkle.build(docs.select("doc_id", "lang", merkle.leaf_of().alias("digest")))
    nodes = made.nodes().collect()
    assert sorted((n.level, n.lo, n.hi) for n in nodes if n.level) == [(1, k, min(k + 8, 100)) for k in range(0, 100, 8)] + [(2, 0, 64), (2, 64, 100), (3, 0, 100)]
    assert made.root == next(n.digest for n in nodes if n.level == 3)


def test_clashing_names(spark):
    docs = edge.docs(spark).select("*", *[F.lit(7).alias(c) for c in ("tree", "lo", "hi", "digest", "path", "kids", "a.b", "row_number", "other")])
    assert results(docs)[0] == results(edge.docs(spark))[0]
