"""The text sieve: what an expression needs, and that a search with it gives the rows of one without."""

import re

import pytest
from helpers import ids, log
from hypothesis import given, settings
from hypothesis import strategies as st
from test_id_index import scanned

from eventloom.functions import grams
from eventloom.operators.documents import search_docs
from eventloom.operators.filters import filter_events
from eventloom.sources import beside, store, text_sieve

DAYS = ["2026-06-11", "2026-06-12"]


def met(need, text):
    """Whether a text has what is needed."""
    if need is None:
        return True
    if isinstance(need, str):
        return need in text.lower()
    return (all if need[0] == "all" else any)(met(n, text) for n in need[1])


PIECES = st.sampled_from(["a", "b", "ab", "abc", "cab", ".", "[ab]", "a?", "(ab)?", "b+", "(abc)+", "(ab|ca)", "(abc|cab|b)", "c{2}", "(?:bca){1,2}", "a*", "^", "(?=ab)"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=6), st.text("abc", max_size=24))
def test_every_match_has_what_is_needed(pieces, text):
    expression = "".join(pieces)
    if re.search(expression, text):
        assert met(grams.of_expression(expression), text)


@pytest.mark.parametrize(
    "expression, wanted",
    [
        ("refused", {"ref", "efu", "fus", "use", "sed"}), ("ab", set()), ("a.b.c", set()), ("(time|out)s?", {"tim", "ime", "out"}), ("(abc|d)", set()),
        ("def+g", {"def"}), ("(ab){2}c", {"aba", "bab", "abc"}), ("\\Qabc\\E", set()), ("[a[b]cde]", set()), ("[ab&&[b]]cde", set()), ("\\0101bcd", set()),
        ("[]abc]def", set()), ("a\\.b(?:cd)", {"a.b", ".bc", "bcd"}), ("(?<name>abc)", set()), ("naïve text", {"ve ", "e t", " te", "tex", "ext"}), ("(?!abc)def", {"def"}), ("\\babc", {"abc"}),
    ],
)
def test_needs_of_expressions(expression, wanted):
    assert set(grams.grams_of(grams.of_expression(expression))) == wanted


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two days, a file for each append; the last append is not in the sieve."""
    path = str(tmp_path_factory.mktemp("sieved") / "events")
    texts = ["connection refused", "Verbindung abgelehnt: Größe", "REFUſED by peer", "refuse\nd", None, "", "ΣΊΣΥΦΟΣ x", "x" * 63 + "needle" + "y" * 200, "\U0001f600" * 62 + "needle"]
    for i, text in enumerate(texts):
        data = {"data": {"note": f"Payload {i} İstanbul" if i % 2 else ["deep", {"Key%d" % i: text}]}} if i != 4 else {}
        docs = [dict(_id=f"{i}{d}", message=text, received_at=f"{day}T0{d}:00:00Z", ids={"run": f"r{i}"}, **data) for d, day in enumerate(DAYS)]
        store.append_new(spark, path, log(spark, docs))
        if i < 8:
            text_sieve.update(spark, path, DAYS)
    return path


@pytest.mark.parametrize("q", ["refused", "REFUSED", "refu.ed", "größe", "needle", "(abge|conn)", "x", "σίσυφος", "refuse\\sd", "nothing here", "needle$", "(?s)e.d$", "kennt"])
def test_searches_give_the_same_rows(spark, table, q):
    for window in ({}, {"from": "2026-06-12T00:00:00Z"}, {"to": "2026-06-12T00:00:00Z"}, {"from": "2027-01-01T00:00:00Z"}):
        plain = filter_events(store.read_events(spark, table), {"q": q, **window})
        assert sorted(ids(text_sieve.filter_stored(spark, table, {"q": q, **window}))) == sorted(ids(plain))


@pytest.mark.parametrize("text", ["payload 3", "ISTANBUL", "istanbul", "key2", "needle", "r5", "\"", "3", "größe", "deep", "null", "absent text", "run"])
def test_document_searches_give_the_same_rows(spark, table, text):
    plain = search_docs(store.read_events(spark, table), text)
    assert sorted(ids(text_sieve.search_stored(spark, table, text))) == sorted(ids(plain))
    later = text_sieve.search_stored(spark, table, text, "2026-06-12T00:00:00Z", "2026-06-13T00:00:00Z")
    assert sorted(ids(later)) == sorted(i for i in ids(plain) if i.endswith("1"))


def test_only_files_that_may_match_are_opened(spark, table):
    everything = len(store.read_events(spark, table).inputFiles())
    found = text_sieve.filter_stored(spark, table, {"q": "conn[a-z]+ refused"})
    assert everything == 18 and len(found.inputFiles()) == 4  # one file a day, and what the sieve does not know
    assert len(found.collect()) == 2 and scanned(found) <= 4
    assert len(text_sieve.filter_stored(spark, table, {"q": "^.$"}).inputFiles()) == everything


def test_sieve_follows_replaced_files(spark, tmp_path):
    path = str(tmp_path / "events")
    for i in range(beside.FAN + 2):
        store.write_events(log(spark, [dict(_id=f"{i}", message=f"word{chr(97 + i) * 3}")]), path)
        text_sieve.update(spark, path, DAYS[:1])
    assert len(beside.kept_files(spark, text_sieve.root(path), DAYS[0])) <= beside.FAN + 1
    store.compact_day(spark, path, DAYS[0])
    assert ids(text_sieve.filter_stored(spark, path, {"q": "WORDCCC"})) == ["2"]
    text_sieve.update(spark, path, DAYS[:1])
    assert ids(text_sieve.filter_stored(spark, path, {"q": "WORDCCC"})) == ["2"]
    assert ids(text_sieve.filter_stored(spark, path, {"q": "wordzzz"})) == []


def test_long_texts(spark, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(log(spark, [dict(_id="long", message="ä" * 400_000 + "target" + "b" * 400_000)]), path)
    text_sieve.update(spark, path, DAYS[:1])
    assert ids(text_sieve.filter_stored(spark, path, {"q": "TARGET"})) == ["long"]
    assert text_sieve.candidates(spark, path, "message", grams.of_expression("tragedy")).inputFiles() == []
