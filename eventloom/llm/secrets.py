"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is read once on the driver and turned into a
Boolean query: an OR of ANDs of trigrams that any match must contain.  The
index holds, for every trigram some rule asks for, the documents that have it.
Postings are intersected per alternative; only documents in the result are
checked with the rule's expression.  A rule without mandatory trigrams is
checked on every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  A match counts when its `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.  For a run of one class, asking for the least length in the pattern is the
# same as dropping shorter runs afterwards, and spares the engine every short run.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ALTERNATIVES = 256


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of which every match has all trigrams of at least one; None when some match need not have any.

    Trigrams are in lower case, for an index of lower-case text.
    """
    found = _runs(parser.parse(pattern), [((), "")])
    if found is None:
        return None
    sets = {frozenset(run[i : i + 3] for run in (*closed, open_run) for i in range(len(run) - 2)) for closed, open_run in found}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _runs(tree, states: list[tuple[tuple[str, ...], str]] | None):
    """Extends each (literal runs, open run) by one parsed sequence; None when there are too many to follow."""
    for op, value in tree:
        if states is None or len(states) > ALTERNATIVES:
            return None
        if op is kinds.LITERAL and value < 128:
            states = [(closed, run + chr(value).lower()) for closed, run in states]
        elif op is kinds.SUBPATTERN:
            states = _runs(value[3], states)
        elif op is kinds.BRANCH:
            parts = [_runs(branch, states) for branch in value[1]]
            states = None if None in parts else [s for part in parts for s in part]
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] <= 1:
            least, most, inner = value
            once = _runs(inner, states)
            if once is not None and most != 1:
                once = [((*closed, run), "") for closed, run in once]
            states = None if once is None else once + ([] if least else states)
            states = states and list(dict.fromkeys(states))
        elif op is kinds.AT:
            continue
        else:
            states = list(dict.fromkeys(((*closed, run), "") for closed, run in states))
    return states


#: Matches of a text whose positions are added up in one list.
CHUNK = 256


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key): each trigram's documents, once each."""
    low = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    has = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select(key, F.explode(F.array_compact(has)).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], key: str = "doc_id") -> DataFrame:
    """(key, rules): the rules whose trigram query each document answers."""
    rows = [(kind, n, t, len(needed)) for kind, query in queries.items() for n, needed in enumerate(query) for t in sorted(needed)]
    asked = index.sparkSession.createDataFrame(rows, "kind string, alternative int, trigram string, needed int")
    # a row per trigram of a rule: the rules' own size, not the data's
    met = index.join(F.broadcast(asked), "trigram").groupBy(key, "kind", "alternative").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    return met.filter("n = needed").groupBy(key).agg(F.collect_set("kind").alias("rules"))


def match_spans(text: Column, rule: Rule, place: int) -> Column:
    """Leftmost, non-overlapping matches as (start, place, end) in characters, end exclusive.

    The pieces between matches and the matches themselves alternate, so their
    lengths add up to positions.  They are added up chunk by chunk: a list that
    grew by one match at a time would be copied once per match.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    wanted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.transform(wanted, F.length).alias("value"),
    )
    none = F.expr("cast(array() as array<struct<start:int,place:int,end:int>>)")

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + F.coalesce(part["size"], F.lit(0))
        found = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(part["value"] >= rule.least, F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    def through(state: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda done: F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,place:int,end:int>>>)").alias("out"))
    chunks = _let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(CHUNK)), lambda i: F.slice(p, i, CHUNK)))
    return F.when(F.size(whole) > 0, F.aggregate(chunks, start, through, lambda state: F.flatten(state["out"]))).otherwise(none)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, found (array of kind, start, end by start, then in the order of `rules`).

    Null and empty texts have no spans; rows that share a key, and rows without
    one, are each checked on their own text; an empty table gives no rows; other
    columns are ignored.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if queries:
        trigrams = sorted({t for q in queries.values() for needed in q for t in needed})
        index = written(build_index(own, trigrams, "_key", "_text"), "trigrams")
        hits = candidates(index, queries, "_key").withColumnRenamed("_key", "_hit")
        own = own.join(hits, F.col("_key").eqNullSafe(F.col("_hit")), "left")
    else:
        own = own.withColumn("rules", F.lit(None).cast("array<string>"))
    spans = []
    for place, rule in enumerate(rules):
        found = match_spans(F.col("_text"), rule, place)
        if rule.kind in queries:
            found = F.when(F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), rule.kind), found)
            found = F.coalesce(found, F.expr("cast(array() as array<struct<start:int,place:int,end:int>>)"))
        spans.append(found)
    names = F.array(*[F.lit(r.kind) for r in rules])
    kept = own.select(F.col("_key").alias(key), F.array_sort(F.concat(*spans)).alias("_spans"))
    named = F.transform("_spans", lambda s: F.struct(F.element_at(names, s["place"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return kept.select(key, named.alias("found"))

