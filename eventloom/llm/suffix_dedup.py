"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Which suffixes to index is decided by content: every 50-byte string has an
anchor, its leftmost 16-byte gram of least hash, so equal strings have equal
anchors.  A first exchange drops anchors that only one document has.  For the
rest, the bytes around each anchor, once per part of the corpus and with the
documents and places that have them there, go to the task that owns the gram.
There, equal ones are taken once and in the order of their smallest documents.
Batches of their suffixes, cut at 50 bytes, are merge-scanned against the sorted
arrays held so far, and what no array holds becomes a new one; equal-sized
arrays merge, so a task holds a logarithmic family of levels.  A string met
before was met in its smallest document, and parts remove the bytes so found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written
from eventloom.llm.parts import LOW, pack_keys, unpack_keys, write_parts
from eventloom.llm.words import mix, span_hash, span_sums

LENGTH, GRAM = 50, 16
PART_BYTES = 1 << 20
#: Suffixes in one batch of the index.
BATCH = 1 << 18
LAST = (1 << 63) - 1


#: Strings whose anchors are found at a time; the arrays stay within a core's cache.
STRINGS = 1 << 15
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))


def _gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes of two words."""
    x = low * np.uint64(0x9E3779B97F4A7C15)
    x += high * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(key, text, begin, end) of every anchor: begin:end are the bytes of all strings it anchors."""
    n, reach = len(data) - length + 1, length - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    words, place = _words(data), np.empty(n, np.int64)
    number = np.arange(STRINGS + reach, dtype=np.uint64)
    for a in range(0, n, STRINGS):
        m = min(STRINGS, n - a)
        grams = m + reach - 1
        some = words[a : a + grams + 8].copy()
        least, size = _gram_hash(some[:grams], some[8 : grams + 8]), 1
        least &= _HIGH  # 32 bits of hash, then the place: of equal hashes the leftmost is least
        least |= number[:grams]
        while size < reach:  # minima of windows of doubling width
            step = min(size, reach - size)
            least = np.minimum(least[step:], least[: len(least) - step])
            size += step
        place[a : a + m] = (least & ~_HIGH).view(np.int64) + a
    whole = np.ones(n + 1, dtype=bool)
    cross = (starts[1:-1, None] - np.arange(1, length)).ravel()  # strings over a text's end
    whole[cross[(cross >= 0) & (cross < n)]] = False
    whole[n] = False
    turn = np.ones(n + 1, dtype=bool)
    turn[1:n] = (place[1:] != place[:-1]) | ~whole[: n - 1]
    begin = np.flatnonzero(whole & turn)
    end = np.flatnonzero(whole[:n] & (turn[1:] | ~whole[1:])) + length
    text = np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(begin, starts)))
    at = place[begin]
    return _gram_hash(words[at], words[at + 8]), text, begin, end


class PartTexts:
    """A part's bytes, its documents, and its anchors grouped by gram."""

    def __init__(self, batch: pa.RecordBatch, i: int, shards: int, length: int) -> None:
        self.part, self.docs, _, self.data, self.starts = part_row(batch, i)
        key, text, self.begin, self.end = anchors(self.data, self.starts, length)
        self.doc = self.docs[text]
        # a shard and 47 more bits name a gram; the lowest bit tells that several documents of the part have it
        name = (((key >> np.uint64(40)) % np.uint64(shards)) << np.uint64(48)) | (mix(key + np.uint64(1)) & LOW & ~np.uint64(1))
        self.order = np.argsort(name)
        name = name[self.order]
        self.fresh = np.ones(len(name), dtype=bool)
        self.fresh[1:] = name[1:] != name[:-1]
        self.name = name[self.fresh]

    def several(self) -> np.ndarray:
        """Whether several documents of the part have each gram."""
        doc, first = self.doc[self.order], np.flatnonzero(self.fresh)
        if not len(first):
            return np.zeros(0, dtype=bool)
        return np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)

    def contexts(self, masks: list[dict]) -> tuple[np.ndarray, ...]:
        """The distinct contexts of repeated grams in order of shards, and the anchors that have them in order of contexts.

        Of contexts: shard, begin, end, hash, first of their anchors and one more.  Of anchors: begin, doc.
        """
        again, shard = np.zeros(len(self.name), dtype=bool), self.name >> np.uint64(48)
        for m in masks:
            a, b = np.searchsorted(shard, (m["shard"], m["shard"] + 1))
            again[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a) > 0
        group = np.cumsum(self.fresh) - 1
        use = again[group]
        mine, shard = self.order[use], shard[group[use]].astype(np.uint16)
        begin, end = self.begin[mine], self.end[mine]
        whole = span_hash(span_sums(self.data), begin, end) ^ (end - begin).astype(np.uint64)
        order = np.argsort(whole)  # equal bytes have equal grams
        order = order[np.argsort(shard[order], kind="stable")]
        whole, shard, begin, end, doc = whole[order], shard[order], begin[order], end[order], self.doc[mine[order]]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = whole[1:] != whole[:-1]
        first = np.append(np.flatnonzero(fresh), len(fresh))
        return shard[fresh].astype(np.int64), begin[fresh], end[fresh], whole[fresh], first, begin, doc


def part_row(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, docs, which of them are known, bytes, starts) of a row of the parts table; unknown documents come last."""
    kinds = {"docs": np.int64, "known": np.uint8, "text": np.uint8, "ends": np.int64}
    docs, known, text, ends = (np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in kinds.items())
    return batch.column("part")[i].as_py(), np.where(known > 0, docs, LAST), known > 0, text, np.concatenate([[0], ends])


def _exploded(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `size` of each, end to end."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of each run of a sorted array."""
    present, first = np.unique(shard, return_index=True)
    yield from zip(present.tolist(), first.tolist(), np.append(first, len(shard))[1:].tolist(), strict=True)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


GRAMS = "shard int, part long, keys binary"
MASKS = "part long, shard int, mask binary"
#: Of each context its bytes, their number and hash and its number of places in the part; of each place where it begins and its document.
CONTEXTS = "shard int, part long, bytes binary, sizes binary, hashes binary, places binary, begins binary, docs binary"
RUNS = "part long, runs binary"
#: Bytes of a part that go.
RUN = np.dtype([("begin", "<u4"), ("end", "<u4")])


def _grams(parts: DataFrame, shards: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = PartTexts(batch, i, shards, length)
                keys = pack_keys((own.name & LOW) | own.several().astype(np.uint64))
                yield _rows([(s, own.part, keys[a:b].tobytes()) for s, a, b in _cuts(own.name >> np.uint64(48))], GRAMS)

    return parts.mapInArrow(run, GRAMS)


def _repeated(grams: DataFrame, shards: int) -> DataFrame:
    """Which of each part's grams are in several documents or parts; a task holds the keys of its shards, six bytes an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for shard, part, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(shard, []).append((part, keys))
        for shard, rows in held.items():
            key = np.concatenate([unpack_keys(k) for _, k in rows])
            _, place, count = np.unique(key >> np.uint64(1), return_inverse=True, return_counts=True)
            again = count > 1
            again[place[(key & np.uint64(1)) > 0]] = True
            mask, at = again[place], 0
            out = []
            for part, keys in rows:
                n = len(unpack_keys(keys))
                out.append((part, shard, np.packbits(mask[at : at + n]).tobytes()))
                at += n
            yield _rows(out, MASKS)

    return grams.repartitionById(shards, "shard").mapInArrow(run, MASKS)


def _contexts(parts: DataFrame, shards: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = PartTexts(batch, i, shards, length)
                shard, begin, end, whole, first, place, doc = own.contexts(batch.column("masks")[i].as_py() or [])
                size = end - begin
                out = []
                for s, a, b in _cuts(shard):
                    data = own.data[_exploded(begin[a:b], size[a:b])]
                    at = slice(first[a], first[b])
                    places = np.diff(first[a : b + 1]).astype(np.uint32), place[at].astype(np.uint32), doc[at]
                    out.append((s, own.part, *(x.tobytes() for x in (data, size[a:b].astype(np.uint16), whole[a:b], *places))))
                yield _rows(out, CONTEXTS)

    return parts.mapInArrow(run, CONTEXTS)


def sorted_order(name: np.ndarray, code: np.ndarray, kind: str | None = None) -> np.ndarray:
    """The order of (name, code).  Names alone nearly decide it; only runs of one name with several codes are sorted twice."""
    order = np.argsort(name, kind=kind)
    n, c = name[order], code[order]
    same = n[1:] == n[:-1]
    mixed = same & (c[1:] != c[:-1])
    if mixed.any():
        run = np.concatenate([[0], np.cumsum(~same)])
        bad = np.zeros(run[-1] + 1, dtype=bool)
        bad[run[1:][mixed]] = True
        at = np.flatnonzero(bad[run])
        sub = order[at]
        order[at] = sub[np.lexsort((code[sub], name[sub]))]
    return order


class Levels:
    """Sorted suffix arrays (name, code, smallest doc), each more than twice as long as the next.

    A name is a suffix's first four bytes and 32 bits of its hash, so arrays are
    in byte order as far as four bytes go; name and code together stand for the
    suffix.
    """

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def array(name: np.ndarray, code: np.ndarray, doc: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes in order, equal ones once, with their smallest doc."""
        order = sorted_order(name, code, kind)
        name, code, doc = name[order], code[order], doc[order]
        first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (code[1:] != code[:-1])))
        return name[first], code[first], np.minimum.reduceat(doc, first)

    def add(self, name: np.ndarray, code: np.ndarray, doc: np.ndarray) -> None:
        """A new batch becomes a level; levels of its size merge with it."""
        if len(name):
            self._push(self.array(name, code, doc))

    def _push(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        while self.held and len(self.held[-1][0]) <= 2 * len(new[0]):
            new = self.array(*(np.concatenate(x) for x in zip(self.held.pop(), new, strict=True)), kind="stable")
        self.held.append(new)

    def scan(self, name: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The smallest doc that any level holds for each suffix; the batch is merged along in its own order."""
        return self._met(name, code, np.full(len(name), LAST), keep=False)

    def meet(self, name: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smallest doc of each suffix in the levels and the batch; what no level holds is added to them.

        Batches must come in the order of their docs: what a level holds is then never undercut.
        """
        return self._met(name, code, doc, keep=True)

    def _met(self, name: np.ndarray, code: np.ndarray, doc: np.ndarray, keep: bool) -> np.ndarray:
        least = np.full(len(name), LAST)
        if not len(name):
            return least
        order = sorted_order(name, code)
        n, c = name[order], code[order]
        fresh = np.append(True, (n[1:] != n[:-1]) | (c[1:] != c[:-1]))
        first = np.flatnonzero(fresh)
        n, c, own = n[first], c[first], np.minimum.reduceat(doc[order], first)
        best = self._held(n, c)
        if keep and (new := best == LAST).any():
            self._push((n[new], c[new], own[new]))
        least[order] = np.minimum(best, own)[np.cumsum(fresh) - 1]
        return least

    def _held(self, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The smallest doc that any level holds for each of an array's suffixes."""
        best = np.full(len(n), LAST)
        for own_name, own, doc in self.held:
            at = np.searchsorted(own_name, n)
            todo = np.arange(len(n))
            while len(todo):  # more than once only where names collide
                inside = at[todo] < len(own_name)
                todo = todo[inside]
                todo = todo[own_name[at[todo]] == n[todo]]
                same = own[at[todo]] == c[todo]
                hit = todo[same]
                best[hit] = np.minimum(best[hit], doc[at[hit]])
                todo = todo[~same]
                at[todo] += 1
        return best


def _suffixes(data: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, code, context number) of every `length`-byte string of every context, in order."""
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    count = size - length + 1
    at = _exploded(starts, count)
    code = span_hash(span_sums(data), at, at + length)
    prefix = np.ndarray(max(len(data) - 3, 0), ">u4", data, strides=(1,))[at].astype(np.uint64)
    return (prefix << np.uint64(32)) | (mix(code) >> np.uint64(32)), code, np.repeat(np.arange(len(size)), count)


def _earlier(contexts: DataFrame, shards: int, length: int) -> DataFrame:
    """The bytes of each part that an earlier document has; a task holds the contexts of its shards and their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return

        def column(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            """The values of all rows end to end, and how many each has."""
            rows = [np.frombuffer(v.as_buffer(), kind) for b in held for v in b.column(name)]
            return np.concatenate(rows), np.array([len(x) for x in rows])

        parts = [p for b in held for p in b.column("part").to_pylist()]
        data, size, whole, places = (column(n, k)[0] for n, k in (("bytes", np.uint8), ("sizes", np.uint16), ("hashes", np.uint64), ("places", np.uint32)))
        (begin, many), (doc, _) = column("begins", np.uint32), column("docs", np.int64)
        held.clear()
        size = size.astype(np.int64)
        _, at, same = np.unique(whole, return_index=True, return_inverse=True)  # equal contexts once
        of = np.repeat(same, places)
        start, size = (np.cumsum(size) - size)[at], size[at]
        least = np.full(len(at), LAST)
        np.minimum.at(least, of, doc)

        levels, found = Levels(), []
        order = np.argsort(least, kind="stable")
        batch = np.cumsum(size[order] - length + 1) // BATCH
        for some in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            own = size[some]
            name, code, context = _suffixes(data[_exploded(start[some], own)], own, length)
            bound = least[some][context]
            early = levels.meet(name, code, bound) < bound
            joined = early[1:] & early[:-1] & (context[1:] == context[:-1])
            first, last = np.flatnonzero(early & ~np.append(False, joined)), np.flatnonzero(early & ~np.append(joined, False))
            ahead_of = (np.cumsum(own - length + 1) - (own - length + 1))[context[first]]
            found.append((some[context[first]], first - ahead_of, last - ahead_of + length))
        context, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(context, kind="stable")
        context, first, last = context[order], first[order], last[order]
        low, high = (np.searchsorted(context, np.arange(len(at)), side) for side in ("left", "right"))

        later = np.flatnonzero(doc > least[of])  # an earlier document has the whole context
        rest = np.flatnonzero(doc == least[of])
        times = (high - low)[of[rest]]
        own = _exploded(low[of[rest]], times)
        rest = np.repeat(rest, times)
        place = np.concatenate([later, rest])
        gone = np.zeros(len(place), RUN)
        gone["begin"] = begin[place] + np.concatenate([np.zeros(len(later), np.int64), first[own]])
        gone["end"] = begin[place] + np.concatenate([size[of[later]], last[own]])
        row = np.repeat(np.arange(len(parts)), many)[place]
        order = np.argsort(row, kind="stable")
        gone = gone[order]
        yield _rows([(parts[r], gone[a:b].tobytes()) for r, a, b in _cuts(row[order])], RUNS)

    return contexts.repartitionById(shards, "shard").mapInArrow(run, RUNS)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(parts: DataFrame) -> DataFrame:
    """Each text without the strings an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, docs, known, data, starts = part_row(batch, i)
                gone = np.zeros(len(data) + 1, np.int32)
                for raw in batch.column("found")[i].as_py() or []:
                    runs = np.frombuffer(raw, RUN)
                    np.add.at(gone, runs["begin"], 1)
                    np.add.at(gone, runs["end"], -1)
                mask = np.cumsum(gone[:-1]) > 0
                edge = mask.copy()
                edge[1:] &= ~mask[:-1]
                inner = starts[:-1][starts[:-1] < len(mask)]
                edge[inner] = mask[inner]
                removed, spans = (np.diff(np.searchsorted(np.flatnonzero(x), starts)) for x in (mask, edge))
                size = np.diff(starts)
                ends = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[~mask])])
                columns = [pa.array(docs, pa.int64(), mask=~known), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), kept]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    return parts.mapInArrow(run, RESULT)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes when a `length`-byte string over it, inside its text, also
    starts in a row with a smaller doc_id; all is judged on the input.  Null and
    empty texts have no bytes.  Rows that share a doc_id never take from each
    other; rows without one come after all others and do not take from each
    other either.  An empty table gives no rows; other columns are ignored.
    Removal is by byte, so what stays need not be valid UTF-8.
    """
    parts, shards = write_parts(docs, PART_BYTES)
    masks = written(_repeated(_grams(parts, shards, length), shards), "masks")
    masked = parts.join(masks.groupBy("part").agg(F.collect_list(F.struct("shard", "mask")).alias("masks")), "part", "left")
    found = written(_earlier(_contexts(masked, shards, length), shards, length), "runs")
    return _removed(parts.join(found.groupBy("part").agg(F.collect_list("runs").alias("found")), "part", "left"))
