"""Packing, sharding, pipeline, registration."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableflow.llm import packing, sharding
from tableflow.llm.common import tokenizer_file
from tableflow.llm.flat import flatten
from tableflow.llm.tokens import encoder_of
from tests.llm import edge


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'streldmv \n\t 　é中12²!?-🙂́")), max_size=30), max_size=8))
def test_ids_equal_the_tokenizer(texts):
    ids, edges = encoder_of(tokenizer_file()).encode(*flatten(pa.array(texts, pa.large_string())))
    want = [e.ids for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:z].tolist() for a, z in zip(edges, edges[1:])] == want


@pytest.mark.parametrize(
    "text",
    [
        "a <|endoftext|> b",
        "<|endoftext|>",
        "<|endoftext|> at the start",
        "at the end <|endoftext|>",
        "doubled<|endoftext|><|endoftext|>é<|endoftext|>",
        "near misses <|endoftext| > <|endof",
        "it's<|endoftext|>'s \n <|endoftext|>\n",
    ],
)
def test_added_tokens_keep_their_ids(text):
    texts = ["before <|endof", text, "text|> behind", text + text]
    ids, edges = encoder_of(tokenizer_file()).encode(*flatten(pa.array(texts, pa.large_string())))
    assert [ids[a:z].tolist() for a, z in zip(edges, edges[1:])] == [e.ids for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]
    if text.startswith("a "):
        assert ids[edges[1] : edges[2]].tolist() == [64, 220, 50256, 275]


def test_forgetting_does_not_change_ids(monkeypatch):
    import tableflow.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMORY", 50)
    encoder, t = tokens.Encoder(tokenizer_file()), _tokenizer()
    for k in range(6):
        ids, _ = encoder.encode(*flatten(pa.array([edge.prose(k, 60)], pa.large_string())))
        assert ids.tolist() == t.encode(edge.prose(k, 60), add_special_tokens=False).ids


def _cost(cuts, costs, sequence):
    total, last = 0.0, 0
    for c in cuts:
        size = c - last
        total += costs[c] + packing.WINDOW + (0 if size in packing.POWERS and size < sequence else sequence - size)
        last = c
    return total


def test_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(packing, "POWERS", (2, 4))
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(3, 16)
        places = sorted({*r.sample(range(1, n), r.randrange(n - 1)), *range(3, n, 5), n})
        costs = {p: float(r.randrange(5)) for p in places}
        costs[n] = 0.0
        got = packing.cut(np.array(places), np.array([costs[p] for p in places]), 8)
        every = [c for k in range(len(places)) for rest in itertools.combinations(places[:-1], k) for c in [[*rest, n]] if all(z - a <= 8 for a, z in zip([0, *c], c))]
        assert _cost(got, costs, 8) == pytest.approx(min(_cost(c, costs, 8) for c in every))


def _check_packing(rows, pieces):
    t = _tokenizer()
    want = Counter()
    for i, text in rows:
        want[(i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 0]))] += 1
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences[p.sequence_id].append(p)
    stream = []
    for s in sorted(sequences):
        at = 0
        for p in sorted(sequences[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            stream.append(p)
        assert at <= packing.SEQUENCE
    got, now = Counter(), []
    for p in stream:  # a document's pieces follow one another
        assert p.start == len(now)
        now += p.ids
        if len(now) == p.doc_tokens:
            got[(p.doc_id, tuple(now))] += 1
            now = []
    assert got == want and not now


@pytest.mark.parametrize("stretch", [packing.STRETCH, 9000])
def test_packing_round_trip(spark, monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None if i is None else i + 1000, t) for i, t, *_ in edge.rows()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    pieces = packing.pack(df, tokenizer_file()).collect()
    _check_packing(rows, pieces)
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    padding = sum(0 if n & (n - 1) == 0 else packing.SEQUENCE - n for n in sizes.values())
    assert padding < 0.02 * sum(sizes.values())


def test_packing_empty_table(spark):
    assert packing.pack(edge.none(spark), tokenizer_file()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    p = sharding.permute(x, n)
    assert sorted(p.tolist()) == x.tolist()
    assert (sharding.permute(p, n, inverse=True) == x).all()
    assert n < 100 or (p != x).mean() > 0.9
    assert all(sharding.row_at(*sharding.place(k, n), n) == k for k in range(min(n, 20)))


def test_sharding_law(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None if i is None else i + 1000, t) for i, t, *_ in edge.rows()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.shard(df).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sharding.place(r.row_number, len(rows)) and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1
    # The same whatever the partitioning.
    again = sharding.shard(df.repartition(5)).collect()
    key = lambda rs: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rs if r.doc_id is not None)
    assert key(again) == key(got)
    assert sharding.shard(edge.none(spark)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = edge.docs(spark).union(edge.docs(spark).withColumn("doc_id", F.col("doc_id") + 100))
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
            assert stage(spark, edge.none(spark), sf).count() == 0
    # Copies with other ids are gone after near_duplicates, empty sets stay.
    kept = cp.drop_near_duplicates(spark, docs, sf)
    texts = Counter(r.text for r in kept.collect())
    assert texts[edge.prose(7, 6000)] == 1 and texts[""] == 2 and texts[None] == 2
    assert all(r[c] == 7 for r in kept.collect() for c in edge.AWKWARD)
    cleaned = cp.drop_repeated_sentences(spark, kept, sf).collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cleaned)


def test_pipeline_runs_over_all_documents(spark):
    import corpus_pipeline as cp

    from tableflow.llm import decontaminate, lines, toxicity
    from tests.llm import brute

    sf = "/root/testdata/sf0.001"
    pieces = cp.run(spark, sf).collect()
    ids = {p.doc_id for p in pieces}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    # Brute force for the decisions that need no model.
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.in_training_part())
    left = sorted(r.doc_id for r in toxicity.score(table.select("doc_id", "text"), model).where(F.col("score") < toxicity.THRESHOLD).collect())
    heads = brute.components([brute.shingles(docs[i], cp.NEAR_WORDS) for i in left], cp.NEAR_PERCENT)
    left = [i for k, i in enumerate(left) if heads[k] == k]
    from tests.llm.test_lines_all import _brute

    texts = dict(zip(left, _brute([(i, docs[i]) for i in left], lines.LONG_WORDS, lines.LONG_BYTES)))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids == {i for i, t in texts.items() if not brute.leaks(t, items, decontaminate.WINDOW)[1]}


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
