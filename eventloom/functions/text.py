"""Text helpers as SQL expressions: UTF-16 lengths and cuts, hashes, slugs."""

from __future__ import annotations


def utf16_units(text: str) -> str:
    """Length in UTF-16 code units, the unit senders measure text in."""
    return f"cast(octet_length(encode({text}, 'UTF-16BE')) / 2 as int)"


def longer_than(text: str, units: int) -> str:
    """Whether text exceeds `units` UTF-16 units.

    UTF-8 takes at least one byte per unit, so short text is decided by its byte size.
    """
    return f"if(octet_length({text}) <= {units}, false, {utf16_units(text)} > {units})"


def utf16_head(text: str, units: int) -> str:
    """The first `units` UTF-16 units; a surrogate pair is never split."""
    wide = f"encode({text}, 'UTF-16BE')"
    cut = f"if(hex(substring({wide}, {2 * units - 1}, 2)) between 'D800' and 'DBFF', {2 * units - 2}, {2 * units})"
    return f"if(octet_length({text}) <= {units}, {text}, decode(substring({wide}, 1, {cut}), 'UTF-16BE'))"


def sha_prefix(text: str, chars: int = 32) -> str:
    """Leading hex digits of the SHA-256 of text."""
    return f"left(sha2({text}, 256), {chars})"


def slugify(name: str, max_chars: int = 80) -> str:
    """Lower case, runs of anything but ``a-z0-9`` to ``-``, no outer dashes, cut to length."""
    return f"left(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '-'), '^-+|-+$', ''), {max_chars})"
