"""Grams (runs of three characters) that a text must have where it matches an expression or holds a needle.

Texts and needles are folded alike, so that whatever matches ignoring case has
the same grams.  Only ASCII characters of an expression count: folding others
is left to the match itself.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as ops
from re import _parser

GRAM = 3
# The characters beyond ASCII that equal an ASCII letter where case is ignored.
FOLDED, PLAIN = "İıſK", "iisk"
# What the two dialects read differently: numbered escapes, nested or intersected classes, a class that begins with "]".
_FOREIGN = re.compile(r"\\\d|&&|\[\^?\]|\[(?:\\.|[^\]\\])*\[")

#: A gram, or ("all" | "any", needs).  Needs that always hold are None.
Need = str | tuple[str, list] | None


def folded(text: str) -> str:
    """SQL text with case folded; ASCII runs stay runs."""
    return f"lower(if(octet_length({text}) = length({text}), {text}, translate({text}, '{FOLDED}', '{PLAIN}')))"


def _all(needs: list[Need]) -> Need:
    parts: list = []
    for need in needs:
        if isinstance(need, tuple) and need[0] == "all":
            parts += need[1]
        elif need:
            parts.append(need)
    single = list(dict.fromkeys(p for p in parts if isinstance(p, str)))
    parts = single + [p for p in parts if not isinstance(p, str)]
    return ("all", parts) if parts else None


def of_text(needle: str) -> Need:
    """Grams of every text that holds the needle, ignoring case."""
    runs = re.split(r"[^\x20-\x7e]+", needle.lower())
    return _all([run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)])


def of_expression(expression: str) -> Need:
    """Grams of every text in which the (Java) expression is found, ignoring case; None where no gram is sure.

    An expression outside what both dialects read alike has no sure grams.
    """
    if _FOREIGN.search(expression):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = _parser.parse(expression)
    except (re.error, OverflowError, RecursionError, Warning):
        return None
    return _of_parts(tree)


def _of_parts(tree) -> Need:
    """Literals next to each other make runs; anything else ends the run and adds what it needs itself."""
    needs, run = [], ""
    for op, arg in _flat(tree):
        if op is ops.LITERAL and 0x20 <= arg <= 0x7E:
            run += chr(arg)
            continue
        repeated = op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0
        if repeated and arg[0] < GRAM and (again := _literal(arg[2])):
            # what is before meets the first copies, what is after the last
            needs.append(of_text(run + again * arg[0]))
            run = again * arg[0]
            continue
        needs.append(of_text(run))
        run = ""
        if op is ops.BRANCH:
            options = [_of_parts(branch) for branch in arg[1]]
            needs.append(("any", options) if all(options) else None)
        elif repeated:
            needs.append(_of_parts(arg[2]))
        elif op is ops.ATOMIC_GROUP:
            needs.append(_of_parts(arg))
    return _all([*needs, of_text(run)])


def _literal(tree) -> str:
    """The text a sequence stands for; empty where it is not just printable ASCII text."""
    parts = list(_flat(tree))
    plain = all(op is ops.LITERAL and 0x20 <= arg <= 0x7E for op, arg in parts)
    return "".join(chr(arg) for _, arg in parts) if plain else ""


def _flat(tree):
    """The parts of a sequence, those of plain groups in place of the group."""
    for op, arg in tree:
        if op is ops.SUBPATTERN:
            yield from _flat(arg[3])
        else:
            yield op, arg


def grams_of(need: Need) -> list[str]:
    """The distinct grams a need names."""
    if need is None:
        return []
    found = [need] if isinstance(need, str) else [g for n in need[1] for g in grams_of(n)]
    return list(dict.fromkeys(found))


def holds(need: Need, has) -> str:
    """SQL of a need, `has` giving the SQL of one gram."""
    if need is None:
        return "true"
    if isinstance(need, str):
        return has(need)
    return "(" + (" and " if need[0] == "all" else " or ").join(holds(n, has) for n in need[1]) + ")"
