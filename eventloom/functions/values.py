"""JSON values in SQL expressions: path lookup, kinds, typed keys, conversions.

Every function takes SQL expression text and gives SQL expression text, to be
used with ``selectExpr`` or ``F.expr``.  `v` stands for a variant; `t` for a
typed value, the struct ``rank, num, str`` of :data:`eventloom.schema.TYPED_VALUE`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from eventloom.schema import HOT_KEYS, KIND_RANK

NUMBER, STRING, OBJECT, ARRAY, BOOLEAN = (
    KIND_RANK[k] for k in ("number", "string", "object", "array", "boolean")
)

# Text that counts as a number when converted to double.  Spark's own cast also
# takes "NaN", "Infinity" and "12d", which JSON senders never mean as numbers.
NUMERIC_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

# Spark's type names of JSON scalars and containers, by kind.
SHAPES = {
    "null": ("VOID",),
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "string": ("STRING",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "boolean": ("BOOLEAN",),
}

# A JSON string literal, matched without backtracking.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'

# Fixed value: the fields that can be grouped by.
IDENTIFIER = re.compile(r"^(app|env|level|event|ids\.[\w.-]+|data\.[\w.-]+)$")


def quote(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _segment(key: str) -> str:
    if "'" not in key:
        return f"['{key}']"
    if '"' not in key:
        return f'["{key}"]'
    raise ValueError(f"path segment mixes both quote characters: {key!r}")


def get(v: str, spot: str, kind: str) -> str:
    """The value at a variant path in a type; NULL when absent or of another type."""
    return f"try_variant_get({v}, {quote(spot)}, {quote(kind)})"


def path(v: str, dotted: str) -> str:
    """Variant at a dotted path; missing gives NULL.

    A numeric segment first names an object key, then an array index.
    """
    run = ""
    for key in dotted.split("."):
        if key.isdigit():
            v = get(v, "$" + run, "variant") if run else v
            v = f"coalesce({get(v, '$' + _segment(key), 'variant')}, {get(v, f'$[{int(key)}]', 'variant')})"
            run = ""
        else:
            run += _segment(key)
    return get(v, "$" + run, "variant") if run else v


def as_object(v: str) -> str:
    """The entries of a JSON object as ``map<string,variant>``; NULL for any other kind."""
    return get(v, "$", "map<string,variant>")


def as_array(v: str) -> str:
    """The items of a JSON array as ``array<variant>``; NULL for any other kind."""
    return get(v, "$", "array<variant>")


def as_text(v: str) -> str:
    """A scalar as text."""
    return get(v, "$", "string")


def _by_shape(v: str, of_kind: dict) -> str:
    """Look up a literal by the kind of a variant, which is inspected once."""
    entries = ", ".join(f"'{shape}', {result}" for kind, result in of_kind.items() for shape in SHAPES[kind])
    return f"map({entries})[substring_index(substring_index(schema_of_variant({v}), '<', 1), '(', 1)]"


def json_kind(v: str) -> str:
    """``null|number|string|object|array|boolean``; NULL when the value is missing."""
    return f"if({v} is null, null, {_by_shape(v, {kind: quote(kind) for kind in SHAPES})})"


def object_keys(v: str) -> str:
    """Keys of a JSON object; NULL for any other kind."""
    return f"map_keys({as_object(v)})"


def _rank(v: str) -> str:
    return _by_shape(v, {kind: r for kind, r in KIND_RANK.items() if kind != "null"})


def typed(v: str) -> str:
    """The typed value of a variant."""
    rank = _rank(v)
    num = f"case {rank} when {NUMBER} then {get(v, '$', 'double')} when {BOOLEAN} then cast({get(v, '$', 'boolean')} as double) end"
    text = f"case {rank} when {STRING} then {as_text(v)} when {OBJECT} then to_json({v}) when {ARRAY} then to_json({v}) end"
    return f"named_struct('rank', {rank}, 'num', {num}, 'str', {text})"


def typed_text(column: str) -> str:
    """The typed value of a text column."""
    return f"named_struct('rank', if({column} is null, null, {STRING}), 'num', cast(null as double), 'str', cast({column} as string))"


def typed_number(column: str) -> str:
    """The typed value of a numeric column."""
    return f"named_struct('rank', if({column} is null, null, {NUMBER}), 'num', cast({column} as double), 'str', cast(null as string))"


def hot_columns(data: str = "data") -> str:
    """Typed side columns of the well-known `data` keys, extracted once at write time."""
    return "named_struct(" + ", ".join(f"'{k}', {typed(path(data, k))}" for k in HOT_KEYS) + ")"


def field(ev: DataFrame, name: str) -> str:
    """Typed value of ``app|env|level|event|message|ids.<key>|data.<path>`` of an event log.

    Well-known `data` keys come from the typed side columns when the log has
    them, everything else from the map or the variant.
    """
    if name.startswith("ids."):
        return typed_text(f"ids[{quote(name[len('ids.'):])}]")
    if name.startswith("data."):
        dotted = name[len("data.") :]
        if dotted in HOT_KEYS and "hot" in ev.columns:
            return f"hot.{dotted}"
        return typed(path("data", dotted))
    return typed_text(name)


def parts(ev: DataFrame, name: str) -> tuple[str, str, str]:
    """``rank, num, str`` of a field for predicates that test the rank before the value.

    Cheaper than :func:`field` on a variant path: values are read without
    checking their kind again, so they mean nothing when the rank differs.
    """
    t = field(ev, name)
    if t.startswith("hot.") or not name.startswith("data."):
        return f"{t}.rank", f"{t}.num", f"{t}.str"
    v = path("data", name[len("data.") :])
    return _rank(v), get(v, "$", "double"), as_text(v)


def to_double(t: str, default: float | None = None) -> str:
    """Number of a typed value: numbers, booleans as 1/0, numeric text; else `default`."""
    out = (
        f"case when {t}.rank in ({NUMBER}, {BOOLEAN}) then {t}.num "
        f"when {t}.rank = {STRING} and {t}.str rlike {quote(NUMERIC_TEXT)} then try_cast(trim({t}.str) as double) end"
    )
    return out if default is None else f"coalesce({out}, {float(default)}D)"


def first_present(*ts: str) -> str:
    """The first typed value that is neither missing nor null, chosen before any conversion."""

    def pick(name: str) -> str:
        whens = " ".join(f"when {t}.rank is not null then {t}.{name}" for t in ts)
        return f"'{name}', case {whens} end"

    return f"named_struct({pick('rank')}, {pick('num')}, {pick('str')})"


def number_text(num: str) -> str:
    """A double as JSON text: no trailing ``.0``, no exponent between 1e-6 and 1e21."""
    size, whole = f"abs({num})", f"{num} = floor({num})"
    text = f"cast({num} as string)"
    # Most numbers end at one of the first two branches, which format directly.
    return f"""case
        when {size} < 1e15 and {whole} then cast(cast({num} as bigint) as string)
        when {size} >= 1e-3 and {size} < 1e7 then {text}
        when {size} >= 1e15 and {size} < 1e21 then cast(try_cast({num} as decimal(38,0)) as string)
        when {size} >= 1e-6 and {size} < 1e15 then regexp_replace(cast(try_cast({num} as decimal(38,18)) as string), '0+$', '')
        else regexp_replace(regexp_replace({text}, '(\\\\.0)?E(?=[0-9])', 'e+'), '(\\\\.0)?E-', 'e-') end"""


def value_text(t: str) -> str:
    """A typed value as text; NULL for missing or null."""
    return (
        f"case when {t}.rank = {NUMBER} then {number_text(t + '.num')} "
        f"when {t}.rank = {BOOLEAN} then if({t}.num = 1, 'true', 'false') else {t}.str end"
    )


def value_kind(t: str) -> str:
    """Kind name of a typed value; ``null`` for missing or null."""
    whens = " ".join(f"when {r} then {quote(kind)}" for kind, r in KIND_RANK.items() if kind != "null")
    return f"case {t}.rank {whens} else 'null' end"


def parse_embedded(text: str) -> str:
    """Variant of a string that holds a JSON object or array; NULL for any other string."""
    return f"if(trim({text}) rlike '^[{{\\\\[]', try_parse_json({text}), null)"


def json_depth(text: str) -> str:
    """Nesting depth of JSON text; the root container is depth 1.

    The runs are possessive: Java's matcher recurses once per character of a run
    it may have to give back, and a string can be as long as a body.
    """
    literals = quote(JSON_STRING + r'|[^\[\]{}"]++')
    step = "if(c in ('{', '['), 1, if(c in ('}', ']'), -1, 0))"
    return (
        f"aggregate(split(regexp_replace({text}, {literals}, ''), ''), named_struct('now', 0, 'top', 0), "
        f"(a, c) -> named_struct('now', a.now + {step}, 'top', greatest(a.top, a.now + {step})), a -> a.top)"
    )


def deeper_than(text: str, limit: int) -> str:
    """Whether JSON text nests deeper than `limit`.

    Nesting to depth d takes at least 2d characters, so short text needs no walk.
    """
    return f"if(length({text}) < {2 * (limit + 1)}, false, {json_depth(text)} > {limit})"
