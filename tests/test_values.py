"""Typed values against plain Python over randomized JSON."""

import json
import random
import re

import pytest

from eventloom.functions import text as tx
from eventloom.functions import values as vl
from eventloom.functions.times import instant, preset_window, resolve_window


def js_text(v):
    """JSON value as text, numbers in JavaScript form."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        if float(v).is_integer() and abs(v) < 1e21:
            return str(int(v))
        text = repr(float(v))
        if "e" in text and 1e-6 <= abs(v) < 1e21:
            text = f"{float(v):.20f}".rstrip("0")
        return re.sub(r"e([-+])0+", r"e\1", text)
    return v


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", dict: "object", list: "array"}[type(v)]


SAMPLES = [
    None, True, False, 0, 1, -7, 42, 1.5, -0.25, 1e3, 1e-7, 12345678.5, 0.00002, 1e21, 2**53, 4503599627370496.5, 0.1, 123456789012345680000,
    "", "42", " 12 ", "-1.5e3", "NaN", "Infinity", "12d", "0x10", "abc", "1.", ".5", "é\n\"q\"", {}, {"a": 1}, [], [1, {"b": None}],
]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(i, json.dumps({"v": v})) for i, v in enumerate(SAMPLES)] + [(len(SAMPLES), "{}")]
    df = spark.createDataFrame(rows, "i int, j string").selectExpr("i", f"{vl.path('parse_json(j)', 'v')} as v")
    return df.selectExpr("i", "v", f"{vl.typed('v')} as t")


def test_kind_text_and_number(sample):
    got = sample.selectExpr(
        "i", f"{vl.json_kind('v')} as kind", f"{vl.value_kind('t')} as tkind", f"{vl.value_text('t')} as text",
        f"{vl.to_double('t')} as num", f"{vl.to_double('t', 0)} as num0",
    ).orderBy("i").collect()
    for row, v in zip(got, SAMPLES):
        assert row.kind == row.tkind == kind(v), v
        if kind(v) not in ("object", "array", "null"):
            assert row.text == js_text(v), v
        want = None
        if isinstance(v, (bool, int, float)):
            want = float(v)
        elif isinstance(v, str) and re.match(vl.NUMERIC_TEXT, v):
            want = float(v)
        assert row.num == want, v
        assert row.num0 == (want or 0.0), v
    missing = got[len(SAMPLES)]
    assert (missing.kind, missing.tkind, missing.text, missing.num) == (None, "null", None, None)


def test_first_present_is_chosen_before_conversion(spark):
    df = spark.sql("""select parse_json('{"a":"abc","b":5}') v union all select parse_json('{"a":null,"b":5}')
                      union all select parse_json('{"b":7}')""")
    df = df.selectExpr(f"{vl.typed(vl.path('v', 'a'))} as a", f"{vl.typed(vl.path('v', 'b'))} as b")
    df = df.selectExpr(f"{vl.first_present('a', 'b')} as f").selectExpr(f"{vl.to_double('f')} as n")
    assert sorted(r.n or -1 for r in df.collect()) == [-1, 5, 7]


def test_paths(spark):
    doc = json.dumps({"a": {"b": [10, {"c": "x"}], "7": "key"}, "q'uote": 1, "0": {"z": 2}})
    df = spark.createDataFrame([(doc,)], "j string").selectExpr("parse_json(j) as v")
    want = {"a.b.0": "10", "a.b.1.c": "x", "a.7": "key", "q'uote": "1", "0.z": "2", "a.b.9": None, "nope.x": None, "a.b.c": None}
    row = df.selectExpr(*[f"{vl.as_text(vl.path('v', p))} as c{i}" for i, p in enumerate(want)]).head()
    assert list(row) == list(want.values())


def test_json_depth_matches_python(spark):
    rng = random.Random(5)

    def nest(d):
        if d == 0:
            return rng.choice([1, "]}[{", 'a"[', None])
        return {"k": nest(d - 1), "s": "}{"} if rng.random() < 0.5 else [nest(d - 1)]

    rows = [(d, json.dumps(nest(d))) for d in range(1, 45)]
    df = spark.createDataFrame(rows, "d int, j string")
    for row in df.selectExpr("d", f"{vl.json_depth('j')} as got", f"{vl.deeper_than('j', 32)} as deep").collect():
        assert row.got == row.d and row.deep == (row.d > 32)


def test_utf16(spark):
    texts = ["", "abc", "é" * 10, "😀" * 6, "a😀" * 5, "abcde😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.selectExpr("t", f"{tx.utf16_units('t')} as n", f"{tx.longer_than('t', 6)} as longer", f"{tx.utf16_head('t', 6)} as head").collect()
    for r in rows:
        wide = r.t.encode("utf-16-be")
        assert r.n == len(wide) // 2 and r.longer == (r.n > 6)
        assert r.head == wide[:12].decode("utf-16-be", "ignore")


def test_slugify(spark):
    names = {"Repeat   Name": "repeat-name", "--A/B--": "a-b", "!!!": "", "x" * 100: "x" * 80}
    df = spark.createDataFrame([(n,) for n in names], "n string").selectExpr("n", f"{tx.slugify('n')} as s")
    assert {r.n: r.s for r in df.collect()} == names


def test_windows():
    now = instant("2024-01-16T00:00:00Z")
    assert resolve_window(now=now) == (instant("2024-01-15T00:00:00Z"), now)
    assert resolve_window(to="2024-01-03", now=now)[0] == instant("2024-01-02T00:00:00Z")
    assert instant("1705363200000") == now == instant(1705363200000)
    assert preset_window("15m", now)[0] == instant("2024-01-15T23:45:00Z")
    for bad in (dict(from_="2024-01-02", to="2024-01-02"), dict(from_="2024-02-01", now=now), dict(from_="nope")):
        with pytest.raises(ValueError):
            resolve_window(**bad)
    with pytest.raises(ValueError):
        preset_window("2h", now)
