import json
from urllib.parse import unquote, urlparse
import os.path

import pytest

from tableflow.functions.config import flatten_placeholders
from tableflow.functions.nested import substitute_nested
from tableflow.functions.text import infix_path, mapping_pairs, prefix_names, split_list, substitute
from tableflow.functions.url import split_object_url


def py_substitute(value, pairs):
    """Brute-force statement of the rule: ordered, literal, all occurrences."""
    if not isinstance(value, str):
        return value
    for k, v in pairs:
        value = value.replace(k, v)
    return value


PAIRS = [("{a}", "{b}"), ("{b}", "X"), ("aa", "b")]


def test_substitute_matches_python_fold(spark):
    values = ["{a}", "{a}{a}", "aaa", "x{b}y", "", None, "{{a}}", "aaaa"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.s for r in df.select(substitute("s", PAIRS).alias("s")).collect()]
    assert got == [py_substitute(v, PAIRS) for v in values]


def test_mapping_refuses_empty_key():
    with pytest.raises(ValueError):
        mapping_pairs({"": "x"})
    assert mapping_pairs({}) == []


def test_substitute_nested_values_not_keys(spark):
    df = spark.createDataFrame(
        [({"p": "{a}", "n": 3}, ["{b}", None], {"{a}": "{a}"}, 7, None)],
        "s struct<p:string, n:int>, arr array<string>, m map<string,string>, num int, nul string",
    )
    row = substitute_nested(df, PAIRS).first()
    assert row.s.p == "X" and row.s.n == 3
    assert row.arr == ["X", None]
    assert row.m == {"{a}": "X"}
    assert row.num == 7 and row.nul is None
    same = substitute_nested(df, []).first()
    assert same.s.p == "{a}"


def test_prefix_and_infix(spark):
    df = spark.createDataFrame([("job", "s3://b/scripts/job.py /scripts/x")], "name string, path string")
    assert prefix_names(df, "name", "").first().name == "job"
    assert prefix_names(df, "name", "dev-").first().name == "dev-job"
    got = df.select(infix_path("path", "dev-").alias("p")).first().p
    assert got == "s3://b/scripts/dev-job.py /scripts/dev-x"


def test_split_list_keeps_empty_parts(spark):
    df = spark.createDataFrame([(1, "a,,b,"), (2, ""), (3, None), (4, "a.b")], "id int, names string")
    out = [(r.id, r.pos, r.name) for r in split_list(df, "names").collect()]
    assert out == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (1, 3, ""), (2, 0, ""), (4, 0, "a.b")]


URLS = [
    "s3://bucket/scripts/job.py",
    "s3://bucket:8080/a/b.py",
    "s3://bucket",
    "s3://bucket/",
    "s3://bucket/dir/",
    "s3://bucket/a+b.py",
    "s3://bucket/a%20b.py",
    "s3://bucket/a b.py",
    "s3://bucket/k.py?versionId=3",
    "s3://bucket/k.py#frag",
    "s3://bucket/a/b;params",
    "s3://bucket/%E2%82%AC.txt",
]


def test_split_object_url_matches_urlparse(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.bucket, r.key, r.base_name) for r in split_object_url(df, "url").collect()}
    for u in URLS:
        p = urlparse(u)
        key = unquote(p.path)[1:]
        assert got[u] == (p.netloc, key, os.path.basename(key)), u


def test_split_object_url_scheme_lower_case(spark):
    df = spark.createDataFrame([("S3://Bucket/Key.py",)], "url string")
    r = split_object_url(df, "url").first()
    p = urlparse("S3://Bucket/Key.py")
    assert (r.scheme, r.bucket, r.key) == (p.scheme, p.netloc, p.path[1:])


def test_split_object_url_bad_escape_and_non_url(spark):
    df = spark.createDataFrame([("s3://b/a%zz.py",), ("not a url",), (None,)], "url string")
    rows = split_object_url(df, "url").collect()
    assert (rows[0].bucket, rows[0].key) == ("b", "a%zz.py")
    assert rows[1].bucket is None and rows[2].key is None


def py_flatten(doc):
    """Brute-force statement of the flattening rule."""
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


DOCS = [
    {"b": "x", "a": 1, "jobs": {"j1": {"k": "v", "n": 3}, "j0": {"z": "w"}}, "g": {"r": "s"}},
    {"env": "dev", "jobs": {}},
    {"env": "dev", "flag": True, "none": None, "list": ["a"]},
    {"jobs": "not an object"},
    {"jobs": {"j": "str", "k": {"x": "1"}}},
    {"a.b": "top", "jobs": {"a": {"b": "job"}}},
    {"jobs": '{"j": {"k": "looks like an object"}}'},
    {"jobs": {"j": '{"k": "a string, not a job"}', "m": {"x": "y"}}},
    {},
]


def test_flatten_matches_rule(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "id int, doc string")
    rows = flatten_placeholders(df, "doc", keep=["id"]).collect()
    for i, d in enumerate(DOCS):
        got = [(r.placeholder, r.value) for r in sorted((r for r in rows if r.id == i), key=lambda r: r.ordinal)]
        assert got == py_flatten(d), d
