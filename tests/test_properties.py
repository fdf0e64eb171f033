"""Property tests: Spark expressions against plain-Python statements of the
same rules on generated inputs (each example is one small Spark job)."""

import os.path
from urllib.parse import unquote, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tableflow.functions.text import split_list, substitute
from tableflow.functions.url import split_object_url
from tableflow.operators.quality import keep_last
from tableflow.operators.reconcile import insert_missing, upsert

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

ALPHABET = "ab{}#-"
texts = st.text(alphabet=ALPHABET, max_size=12)
keys = st.text(alphabet=ALPHABET, min_size=1, max_size=3)


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), texts), min_size=1, max_size=8),
       pairs=st.lists(st.tuples(keys, st.text(alphabet=ALPHABET, max_size=3)), max_size=4))
def test_substitute_is_the_ordered_fold(spark, values, pairs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.s for r in df.select("i", substitute("s", pairs).alias("s")).collect()}
    for i, v in enumerate(values):
        want = v
        if want is not None:
            for k, x in pairs:
                want = want.replace(k, x)
        assert got[i] == want


@SETTINGS
@given(values=st.lists(st.text(alphabet="a,. b", max_size=10), min_size=1, max_size=6))
def test_split_list_is_str_split(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, names string")
    got = sorted((r.i, r.pos, r.name) for r in split_list(df, "names").collect())
    want = sorted((i, p, x) for i, v in enumerate(values) for p, x in enumerate(v.split(",")))
    assert got == want


TOKENS = ["a", "B", "/", " ", "+", "%20", "%2B", "%23", "%E2%82%AC", "é", ";", "-", ".", "%25", "?", "#", "//"]


@SETTINGS
@given(parts=st.lists(st.lists(st.sampled_from(TOKENS), max_size=8), min_size=1, max_size=6),
       bucket=st.sampled_from(["b", "my-bucket", "b.example:9000"]))
def test_object_url_matches_urlparse(spark, parts, bucket):
    urls = [f"s3://{bucket}/" + "".join(p) for p in parts]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.bucket, r.key, r.base_name) for r in split_object_url(df, "url").collect()}
    for u in urls:
        p = urlparse(u)
        key = unquote(p.path)[1:]
        assert got[u] == (p.netloc, key, os.path.basename(key)), u


rows = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50), st.sampled_from(["x", "y", "z"])), max_size=12)


@SETTINGS
@given(target=rows, source=rows)
def test_upsert_laws(spark, target, source):
    schema = "k int, seq int, v string"
    t = keep_last(spark.createDataFrame(target, schema), "k", "seq")
    s = spark.createDataFrame(source, schema)
    once = upsert(t, s, "k", order_by=["seq", "v"])
    twice = upsert(once, s, "k", order_by=["seq", "v"])
    assert sorted(once.collect()) == sorted(twice.collect())
    # Python statement: last (seq, v) per key in the source wins over the target.
    last = {}
    for k, seq, v in source:
        if k not in last or (seq, v) > last[k]:
            last[k] = (seq, v)
    want = {k: (seq, v) for k, seq, v in (tuple(r) for r in t.collect())}
    want.update(last)
    assert {r.k: (r.seq, r.v) for r in once.collect()} == want
    ins = {r.k: (r.seq, r.v) for r in insert_missing(t, s, "k", order_by=["seq", "v"]).collect()}
    base = {k: (seq, v) for k, seq, v in (tuple(r) for r in t.collect())}
    assert ins == {**last, **base}


# ---------------------------------------------------------------- config flattening

import json  # noqa: E402

from tableflow.functions.config import flatten_placeholders  # noqa: E402
from tableflow.functions.nested import substitute_nested  # noqa: E402


def py_flatten(doc):
    out = {}
    for k, v in doc.items():
        if isinstance(v, str):
            out["{" + k + "}"] = v
        elif isinstance(v, dict) and k == "jobs":
            for job, conf in v.items():
                if isinstance(conf, dict):
                    for jk, jv in conf.items():
                        if isinstance(jv, str):
                            out["{" + job + "." + jk + "}"] = jv
    return list(out.items())


names = st.text(alphabet="ab.", min_size=1, max_size=3)
scalars = st.one_of(st.text(alphabet="xy{}", max_size=4), st.integers(-5, 5), st.booleans(), st.none())
job_conf = st.one_of(st.dictionaries(names, scalars, max_size=3), scalars, st.just('{"k": "not a job"}'))
top_value = st.one_of(scalars, st.lists(scalars, max_size=2), st.dictionaries(names, scalars, max_size=2))
docs = st.builds(
    lambda top, jobs: {**top, **({"jobs": jobs} if jobs is not None else {})},
    st.dictionaries(names.filter(lambda n: n != "jobs"), top_value, max_size=4),
    st.one_of(st.none(), st.dictionaries(names, job_conf, max_size=3), scalars,
              st.just('{"j": {"k": "a string that looks like an object"}}')),
)


@SETTINGS
@given(batch=st.lists(docs, min_size=1, max_size=6))
def test_flatten_matches_rule_on_random_documents(spark, batch):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(batch)], "id int, doc string")
    rows = flatten_placeholders(df, "doc", keep=["id"]).collect()
    for i, d in enumerate(batch):
        got = [(r.placeholder, r.value) for r in sorted((r for r in rows if r.id == i), key=lambda r: r.ordinal)]
        assert got == py_flatten(d), d


# ---------------------------------------------------------------- nested substitution

NESTED = "s struct<a:string, n:int, inner:struct<b:string>>, arr array<string>, m map<string,string>"
PAIRS = [("{a}", "{b}"), ("{b}", "X"), ("x", "yy")]
small = st.one_of(st.none(), st.text(alphabet="x{ab}", max_size=6))


def py_sub(v):
    if v is None:
        return None
    for k, x in PAIRS:
        v = v.replace(k, x)
    return v


@SETTINGS
@given(rows=st.lists(st.tuples(
    st.one_of(st.none(), st.tuples(small, st.integers(0, 3), st.one_of(st.none(), st.tuples(small)))),
    st.one_of(st.none(), st.lists(small, max_size=3)),
    st.one_of(st.none(), st.dictionaries(st.text(alphabet="x{a}", min_size=1, max_size=4), small, max_size=3)),
), min_size=1, max_size=5))
def test_substitute_nested_matches_recursive_rule(spark, rows):
    df = spark.createDataFrame(rows, NESTED)
    got = substitute_nested(df, PAIRS).collect()
    for (s, arr, m), r in zip(rows, got):
        if s is None:
            assert r.s is None
        else:
            assert r.s.a == py_sub(s[0]) and r.s.n == s[1]
            assert (r.s.inner is None) if s[2] is None else (r.s.inner.b == py_sub(s[2][0]))
        assert r.arr == (None if arr is None else [py_sub(x) for x in arr])
        assert r.m == (None if m is None else {k: py_sub(v) for k, v in m.items()})
