"""Operators on the inside of documents, and projects."""

import itertools
import json
import random

import pytest
from helpers import ids, log
from pyspark.sql import functions as F

from eventloom.operators import documents, projects


def flatten(v, at):
    """Leaves of a JSON value in plain Python."""
    kids = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
    if not kids:
        return [(at, v)]
    return [leaf for k, x in kids for leaf in flatten(x, f"{at}.{k}")]


DOCS = [
    {"a": 1, "b": {"c": [1, {"d": None}], "e": {}}, "f": []},
    {"deep": {"1": {"2": {"3": {"4": {"5": {"6": {"7": {"8": "end"}}}}}}}}},
    {"s": 'say "Needle" \\ n', "NEEDLE": 0},
    {},
]


def test_leaf_paths(spark):
    ev = log(spark, [dict(data=d, ids={"u": i}) for i, d in enumerate(DOCS)] + [{}])
    got = {}
    for r in documents.leaf_paths(ev, 12).collect():
        got.setdefault(r._id, set()).add((r.path, r.kind, r.value))
    for i, d in enumerate(DOCS):
        want = {(p, k, t) for p, k, t in (
            (p, {dict: "object", list: "array", int: "number", str: "string", type(None): "null"}[type(v)],
             None if v is None else v if isinstance(v, str) else json.dumps(v)) for p, v in flatten(d, "data"))}
        assert got[f"id-{i:03d}"] == want | {("ids.u", "string", str(i))}
    shallow = [r.value for r in documents.leaf_paths(ev, 2).filter("path = 'data.deep.1'").collect()]
    assert json.loads(shallow[0]) == DOCS[1]["deep"]["1"]


def test_search(spark):
    ev = log(spark, [dict(data=d, ids={"u": f"user{i}"}) for i, d in enumerate(DOCS)] + [{}])
    assert ids(documents.search_docs(ev, "needle")) == ["id-002"]
    assert ids(documents.search_docs(ev, '"NEEDLE" \\')) == ["id-002"]
    assert ids(documents.search_docs(ev, "USER1")) == ["id-001"]
    assert ids(documents.search_docs(ev, '":')) == []


def test_pairs(spark):
    ev = log(spark, [dict(data=d) for d in (
        {"request": {"a": 1}, "response": '{"b": [2]}', "req": 1, "res": 2}, {"req": None, "res": "plain"}, {"prompt": "p"},
        {"messages": [1], "output": "{broken"}, {},
    )])
    got = [tuple(r) for r in documents.req_res_pairs(ev).collect()]
    assert got == [
        ("id-000", "request", "response", '{"a":1}', '{"b":[2]}'), ("id-001", "req", "res", None, "plain"),
        ("id-003", "messages", "output", "[1]", "{broken"),
    ]


def test_redact(spark):
    ev = log(spark, [
        dict(ids={"authToken": "t", "user": "u"}, data={"a": [{"Password": {"x": 1}, "n": 1.5}], "ok": 'a "secret": b'}),
        dict(ids={"user": "u"}, data={"n": 1}), {},
    ])
    rows = documents.redact(ev).withColumn("data", F.to_json("data")).orderBy("_id").collect()
    assert rows[0].ids == {"authToken": "***", "user": "u"}
    assert json.loads(rows[0].data) == {"a": [{"Password": "***", "n": 1.5}], "ok": 'a "secret": b'}
    assert (rows[1].ids, json.loads(rows[1].data), rows[2].ids, rows[2].data) == ({"user": "u"}, {"n": 1}, None, None)


def test_redact_after_long_strings(spark):
    for text in ("y" * 100_000, '"' * 100_000, 'a "secret": b ' * 10_000, "secret" * 50_000):
        data = {"long": text, text[:40_000]: 1, "apiKey": "k", "n": {'q"token': [text]}}
        (row,) = documents.redact(log(spark, [dict(data=data)])).select(F.to_json("data").alias("d")).collect()
        kept = "***" if "secret" in text else 1
        assert json.loads(row.d) == {"long": text, text[:40_000]: kept, "apiKey": "***", "n": {'q"token': "***"}}


def test_validate_projects(spark):
    cases = [
        ('{"name": " Web ", "apps": ["a", "b", "a"]}', "Web", ["a", "b"], None),
        ('{"name": "x"}', "x", [], None),
        ("[]", None, None, "project body must be a JSON object"),
        ('{"name": "x", "slug": "y"}', None, None, 'unknown key "slug"'),
        ('{"apps": []}', None, None, "name is required"),
        ('{"name": 5}', None, None, "name must be a string"),
        ('{"name": "  "}', None, None, "name must be a non-empty string"),
        (json.dumps({"name": "n" * 81}), None, None, "name exceeds 80 chars"),
        ('{"name": "x", "apps": "a"}', None, None, "apps must be an array of strings"),
        (json.dumps({"name": "x", "apps": ["a"] * 201}), None, None, "apps exceeds 200 entries"),
        ('{"name": "x", "apps": ["a", ""]}', None, None, "each app must be a non-empty string"),
        ('{"name": "x", "apps": [null]}', None, None, "each app must be a non-empty string"),
        (json.dumps({"name": "x", "apps": ["a" * 129]}), None, None, "app name exceeds 128 chars"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")
    rows = projects.validate_projects(df).orderBy("i").collect()
    assert [(r.name, r.apps, r.error) for r in rows] == [c[1:] for c in cases]


def test_slugs_follow_creation_order(spark):
    names = ["Repeat Name", "repeat   name!", "A", "a 2", "a!", "a?", "a-2!", "!!!", "???", "b 3", "b", "b.", "b,", "c"]
    want = ["repeat-name", "repeat-name-2", "a", "a-2", "a-3", "a-4", "a-2-2", "project", "project-2", "b-3", "b", "b-2", "b-4", "c"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, created_at int")
    assert [r.slug for r in projects.assign_slugs(df).orderBy("created_at").collect()] == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slugs_equal_one_by_one_assignment(spark, seed):
    draw = random.Random(seed)
    tails = ["", " 2", " 3", " 4", " 2 2", " 2 3", " 02", " 1", " 7"]
    names = [draw.choice(["team", "crew"]) + draw.choice(tails) + "!" * draw.randrange(9) for _ in range(150)]
    taken = []
    for name in names:
        root = name.rstrip("!").replace(" ", "-")
        taken.append(next(s for n in itertools.count(1) if (s := root if n == 1 else f"{root}-{n}") not in taken))
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, created_at int")
    assert [r.slug for r in projects.assign_slugs(df).orderBy("created_at").collect()] == taken


def test_names_are_unique_ignoring_case(spark):
    df = spark.createDataFrame([("Web", 1), ("WEB", 2), ("api", 3)], "name string, created_at int")
    kept, clash = projects.unique_names(df)
    assert sorted(r.name for r in kept.collect()) == ["Web", "api"] and [r.name for r in clash.collect()] == ["WEB"]
    listed = projects.list_projects(projects.assign_slugs(kept).withColumn("apps", F.array(F.lit("a"))))
    assert [r.slug for r in listed.collect()] == ["api", "web"]


def test_search_finds_numbers_and_nulls_as_shown(spark):
    ev = log(spark, [dict(_id="a", data=dict(n=1.5e7, m=1e-7, z=None)), dict(_id="b", data=dict(s="x"))])
    for text in ("15000000", "1e-7", "null", "ul"):
        assert ids(documents.search_docs(ev, text)) == ["a"], text


def test_leaves_go_as_deep_as_ingest_admits(spark):
    data = leaf = {}
    for _ in range(20):
        leaf["k"] = leaf = {}
    leaf["end"] = 1
    got = documents.leaf_paths(log(spark, [dict(_id="a", data=data)])).collect()
    assert [(r.path, r.value) for r in got] == [("data." + "k." * 20 + "end", "1")]
