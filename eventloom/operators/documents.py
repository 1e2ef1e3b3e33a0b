"""Operators that look inside `ids` and `data` of each event.

Documents are taken apart row by row, without a shuffle.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.values import (
    JSON_STRING,
    as_array,
    as_object,
    as_text,
    json_kind,
    parse_embedded,
    path,
    quote,
    typed,
    value_kind,
    value_text,
)
from eventloom.schema import PAYLOAD_PAIRS, SENSITIVE_KEYS, Limits

MAX_DEPTH = Limits.max_depth


def _leaves(ev: DataFrame, max_depth: int) -> DataFrame:
    """One row per leaf of `ids` and `data`: ``_id``, the keys from the root down, the value.

    A document's parts are one list that grows level by level inside the row,
    for as many levels as that document has; only the finished leaves become
    rows.  Empty containers count as leaves, and so do containers at the depth
    limit, so every part of a document is in one leaf.
    """
    part = "array<struct<keys: array<string>, value: variant, open: boolean>>"
    under = "named_struct('keys', concat(e.keys, array({key})), 'value', {value}, 'open', true)"
    fields = f"transform(map_entries({as_object('e.value')}), x -> {under.format(key='x.key', value='x.value')})"
    items = f"transform({as_array('e.value')}, (x, i) -> {under.format(key='cast(i as string)', value='x')})"
    leaf = "array(named_struct('keys', e.keys, 'value', e.value, 'open', false))"
    # a scalar has no inside; the list of an inside is looked at twice but made once
    inside = f"transform(array(coalesce({fields}, {items})), c -> if(size(c) > 0, c, {leaf}))[0]"
    deeper = f"flatten(transform(parts, e -> if(e.open, {inside}, array(e))))"
    grown = f"aggregate(sequence(1, {max_depth}), parts, (parts, level) -> if(exists(parts, e -> e.open), {deeper}, parts))"
    roots = [("ids", "to_variant_object(ids)"), ("data", "data")]
    one = [f"named_struct('root', '{root}', 'value', {value})" for root, value in roots]
    df = ev.selectExpr("_id", f"inline(array({', '.join(one)}))").filter("value is not null")
    df = df.selectExpr("_id", "root", f"cast(array(named_struct('keys', cast(array() as array<string>), 'value', value, 'open', true)) as {part}) as parts")
    return df.selectExpr("_id", "root", f"inline({grown})").drop("open")


def leaf_paths(ev: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per leaf of `ids` and `data`: ``_id, path, kind, value``."""
    leaves = _leaves(ev, max_depth).selectExpr("_id", "concat_ws('.', root, keys) as path", f"{typed('value')} as t")
    return leaves.selectExpr("_id", "path", f"{value_kind('t')} as kind", f"{value_text('t')} as value")


def in_json_text(text: str) -> bool:
    """Whether every document with the text in a key or scalar has it, ignoring case, in its JSON text."""
    escaped = json.dumps(text, ensure_ascii=False) != f'"{text}"'  # escapes would hide it
    return not escaped and bool(set(text.lower()) - set("0123456789.-+e"))  # a number may be spelt otherwise


def _in_text(json_text: str, needle: str) -> str:
    """A cheap test that holds for every document with the needle in a key or scalar."""
    return f"coalesce(contains(lower({json_text}), {quote(needle)}), false)" if in_json_text(needle) else "true"


def search_docs(ev: DataFrame, text: str, max_depth: int = Limits.max_depth) -> DataFrame:
    """Events with the text, ignoring case, in any key or scalar value of `ids` or `data`.

    Documents are first sifted by their JSON text; only candidates are taken
    apart, down to the depth ingest admits, and only their ids meet the events
    again.
    """
    needle = text.lower()
    candidates = ev.filter(f"{_in_text('to_json(ids)', needle)} or {_in_text('to_json(data)', needle)}")
    leaves = _leaves(candidates, max_depth).selectExpr("_id", "keys", "value", f"{typed('value')} as t")
    in_key = f"exists(keys, k -> contains(lower(k), {quote(needle)}))"
    in_value = f"coalesce(contains(lower({value_text('t')}), {quote(needle)}), false)"
    if needle in "null":
        in_value += " or is_variant_null(value)"
    hits = leaves.filter(f"{in_key} or {in_value}").select("_id").distinct()
    return candidates.join(hits, "_id", "left_semi")


def req_res_pairs(ev: DataFrame) -> DataFrame:
    """Events whose `data` holds a request/response pair, with the first pair's keys and both sides.

    A side that is text holding JSON is parsed; ``request`` and ``response`` are
    text, JSON text for structured sides.  A key present with null counts.
    """
    whens = " ".join(
        f"when {path('data', req)} is not null and {path('data', res)} is not null then named_struct("
        f"'request_key', {quote(req)}, 'response_key', {quote(res)}, "
        f"'request', {path('data', req)}, 'response', {path('data', res)})"
        for req, res in PAYLOAD_PAIRS
    )
    keys, sides = ("request_key", "response_key"), ("request", "response")
    pairs = ev.selectExpr("_id", f"case {whens} end as pair").filter("pair is not null").select("_id", "pair.*")

    def text(side: str) -> str:
        return f"if({json_kind(side)} = 'string', {as_text(side)}, null)"

    parsed = pairs.selectExpr("_id", *keys, *[f"coalesce({parse_embedded(text(s))}, {s}) as {s}" for s in sides])
    shaped = parsed.selectExpr("_id", *keys, *[f"{typed(s)} as {s}" for s in sides])
    return shaped.selectExpr("_id", *keys, *[f"{value_text(s)} as {s}" for s in sides])


def truncated_report(ev: DataFrame) -> DataFrame:
    """Events whose payload was cut: original size and the head that was kept."""
    return ev.filter(F.try_variant_get("data", "$._truncated", "boolean")).select(
        "_id", "app", "event", "received_at",
        F.try_variant_get("data", "$._originalBytes", "bigint").alias("original_bytes"),
        F.try_variant_get("data", "$._head", "string").alias("head"),
    )


def redact(ev: DataFrame, pattern: str = SENSITIVE_KEYS) -> DataFrame:
    """Mask the values of sensitive keys in `ids` and, at any depth, in `data`.

    `ids` is masked by built-ins.  `data` is handed to Python only for events
    with a matching key somewhere in their JSON text.
    """
    sensitive = re.compile(pattern, re.IGNORECASE)

    def mask(value):
        if isinstance(value, dict):
            return {k: "***" if sensitive.search(k) else mask(v) for k, v in value.items()}
        return [mask(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(mask(json.loads(t)), ensure_ascii=False))

    text = F.to_json("data")
    # Every literal is matched, with the colon if one follows: no part of a text is looked at twice.
    literals = F.regexp_extract_all(text, F.lit(JSON_STRING + r"\s*+:?+"), F.lit(0))
    needs = text.rlike(f"(?i){pattern}") & F.exists(literals, lambda k: k.endswith(":") & k.rlike(f"(?i){pattern}"))
    return ev.withColumn(
        "ids", F.transform_values("ids", lambda k, v: F.when(k.rlike(f"(?i){pattern}"), F.lit("***")).otherwise(v))
    ).withColumn(
        "data", F.coalesce(F.parse_json(masked(F.when(needs, text))), F.col("data"))
    )
