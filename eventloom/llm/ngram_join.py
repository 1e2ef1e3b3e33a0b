"""Jaccard self-join on word n-grams by PartEnum signatures.

A text is its set of k-word shingles.  Set sizes fall into bands, each as wide
as the threshold allows two similar sets to differ, so similar sets are in one
band or in neighbours; every band is an instance that its own sets and those of
the band below take part in.  Two sets of an instance that reach the threshold
differ in at most `bound` elements.  The domain is hashed into groups of
`PARTS` parts: more groups than sets within the bound can make differ in more
than `SPARE` elements each.  So in some group at most `SPARE` parts differ, and
the two sets agree on the other ones: every subset of PARTS - SPARE parts of a
group, with the elements a set has there, is one signature, and similar sets
share one.

Nearly all parts hold elements.  A set with elements in more parts than its
similar sets can make differ agrees with each of them on one that is not empty,
so empty subsets are no signatures; only a set with too few such parts gives
them too.  In the parts' order, those filled in either set before the first that
agrees all differ, so each set's first filled parts, one more than can differ,
are enough.  The guarantee holds without exception.

Equal sets are one class.  Of the classes that share a signature, each first
meets one of them; where that does not make them one component, what is left
meets in tiles of bounded size.  A tile first compares parity sketches, a bit
per place of a hashed set: an element that one of two sets lacks flips one bit,
so more unlike bits than elements may differ rule a pair out for certain.  Only
classes with a pair that is not ruled out send their texts to the tile, which
compares full sets.  Only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import components, doc_key, step
from eventloom.llm.words import mix, shingles, small_batches, split_words

#: Second-level parts of a group, and how many of them may differ.  One part alone then makes a signature.
PARTS, SPARE = 2, 1
#: Shingles and sets of a tile's side, about.
TILE, TILE_SETS = 200_000, 4096


def bands(largest: int, threshold: int) -> list[int]:
    """Largest set size of every band up to the one that holds `largest`; sizes start at 1."""
    out, low = [], 1
    while not out or out[-1] < largest:
        out.append(max(low, low * 100 // threshold))
        low = out[-1] + 1
    return out


def bound(both: int, threshold: int) -> int:
    """Elements that two sets of `both` elements together differ in at most when they reach the threshold."""
    return both * (100 - threshold) // (100 + threshold)


def groups(top: int, threshold: int) -> int:
    """Groups of an instance of sets up to `top`: one more than may differ too much, and some in reserve for empty parts."""
    few = bound(2 * top, threshold) // (SPARE + 1)
    return few + 1 + few // 24 + 2


def distinct_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every text end to end, sorted within a text; where each text begins)."""
    hashes, owner, _, _ = split_words(column)
    value, of = shingles(hashes, owner, k)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.searchsorted(of[fresh], np.arange(len(column) + 1))


def signatures(value: np.ndarray, starts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number), ordered by set, of sets given as in :func:`distinct_sets`."""
    size = np.diff(starts)
    tops = np.array(bands(int(size.max(initial=1)) * 100 // threshold + 1, threshold))
    own = np.searchsorted(tops, size)
    chosen = [list(c) for c in combinations(range(PARTS), PARTS - SPARE)]
    element = mix(value)
    low, high = (element & np.uint64(0xFFFFFFFF)).astype(np.float64), (element >> np.uint64(32)).astype(np.float64)
    place = mix(value ^ np.uint64(0x51ED270B))
    found, owners = [], []
    for above in (0, 1):
        # a set meets the band above only where that one begins within reach
        part = np.flatnonzero((size > 0) & (size * 100 // threshold >= (tops[own - 1 + above] + 1 if above else 0)))
        if not len(part):
            continue
        band = own[part] + above
        n = groups(tops[band], threshold)
        differ = bound(size[part] + np.minimum(size[part] * 100 // threshold, tops[band]), threshold)
        first = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(np.arange(len(part)), size[part])
        at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(size[part])[:-1]]), size[part]) + np.arange(len(of))
        group = (place[at] >> np.uint64(8)) % n[of].astype(np.uint64)
        cell = (first[of] + group.astype(np.int64)) * PARTS + (place[at] & np.uint64(0xFF)).astype(np.int64) % PARTS
        cells = int(first[-1]) * PARTS
        # sums of 32-bit halves are exact in doubles; together they name what a part holds
        held = np.bincount(cell, minlength=cells).reshape(-1, PARTS)
        sums = [np.bincount(cell, half[at], cells).astype(np.uint64).reshape(-1, PARTS) for half in (low, high)]
        name = mix(sums[0]) ^ mix(sums[1] + np.uint64(0x632BE5AB)) + held.astype(np.uint64)
        who = np.repeat(np.arange(len(part)), n)
        number = (np.arange(len(who)) - first[who]).astype(np.uint64)
        filled = np.cumsum(held.ravel() > 0)
        begin = np.concatenate([[0], filled])[first * PARTS]
        enough = np.diff(begin) > differ
        # the first part that agrees is among each set's first parts: before it, every filled part differs
        early = (filled - begin[:-1][who].repeat(PARTS)).reshape(-1, PARTS) <= differ[who][:, None] + 1
        for which, parts in enumerate(chosen):
            base = mix((band[who].astype(np.uint64) << np.uint64(40)) + number * np.uint64(len(chosen)) + np.uint64(which))
            for p in parts:
                base = mix(base * np.uint64(31) + name[:, p])
            keep = ((held[:, parts] > 0) & early[:, parts]).any(axis=1) | ~enough[who]
            found.append(base[keep])
            owners.append(part[who[keep]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    signature, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return signature[order], owner[order]


def parities(value: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A bit per place of each set, as many places as the next power of two from its size on (64 at least), told by element count parity."""
    size = np.diff(starts)
    places = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(places)])
    of = np.repeat(np.arange(len(size)), size)
    place = (mix(value ^ np.uint64(0x7A3D90C5)) & (places[of] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(first[of] + place, minlength=int(first[-1])) & 1).astype(np.uint8))
    return [bits[a:b].tobytes() for a, b in zip(first[:-1] // 8, first[1:] // 8, strict=True)]


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per document: the size, fingerprint and parity sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            value, starts = distinct_sets(batch.column(1), k)
            size = np.diff(starts)
            # order-free sums of two mixings, with the size, name a set
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(s)))]) for s in (0x2545F491, 0x9E6C63D0876A9A47)]
            fp = np.stack([size.astype(np.uint64), *(s[starts[1:]] - s[starts[:-1]] for s in sums)], axis=1)
            names = pa.array([row.tobytes() for row in fp], pa.binary())
            sketches = pa.array(parities(value, starts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), names, sketches], ["doc_id", "n_shingles", "fp", "parity"])

    return doc_key(docs).mapInArrow(run, "doc_id long, n_shingles long, fp binary, parity binary")


def sign(texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """A row per text (rep, text) and signature: key, rep, n (size of its set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            value, starts = distinct_sets(batch.column(1), k)
            signature, owner = signatures(value, starts, threshold)
            rep, size = np.asarray(batch.column(0))[owner], np.diff(starts)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(rep), pa.array(size)], ["key", "rep", "n"])

    return texts.select("rep", "text").mapInArrow(run, "key long, rep long, n long")


def _open_pairs(tiles: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The rows of tiles (tile, side, rep, comp) that could link with one of the other side in another component."""

    def compare(rows: pa.Table) -> pa.Table:
        side, comp, n = (rows.column(c).to_numpy() for c in ("side", "comp", "n"))
        given = rows.column("parity").to_pylist()
        width = min(map(len, given))
        # halving the places adds up parities
        bits = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in given]
        bits = np.stack(bits)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hope = np.zeros(len(side), dtype=bool)
        for i in one:
            others = two[(comp[two] != comp[i]) & (100 * np.minimum(n[two], n[i]) >= threshold * np.maximum(n[two], n[i]))]
            unlike = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            others = others[unlike <= bound(n[others] + n[i], threshold)]
            hope[others] = True
            hope[i] |= len(others) > 0
        return rows.select(["tile", "side", "rep", "comp"]).filter(pa.array(hope))

    return tiles.join(sketches, "rep").select(*tiles.columns, "n", "parity").groupBy("tile").applyInArrow(compare, tiles.schema)


def _links(tiles: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) between the components of the sides of every tile (tile, side, rep, comp), from full sets.

    A tile gives each two components once, however many of their members link.
    """

    def compare(rows: pa.Table) -> pa.Table:
        side, comp = (rows.column(c).to_numpy() for c in ("side", "comp"))
        value, offset = distinct_sets(rows.column("text"), k)
        size = np.diff(offset)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        held = np.repeat(side, size) == 1
        owner = np.repeat(np.searchsorted(two, np.arange(len(size))), size)[held]
        order = np.argsort(value[held], kind="stable")
        domain, owner = value[held][order], owner[order]
        a, b = [], []
        for i in one:
            x = value[offset[i] : offset[i + 1]]
            low, high = np.searchsorted(domain, x, "left"), np.searchsorted(domain, x, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(two))
            hit = (shared > 0) & (100 * shared >= threshold * (size[i] + size[two] - shared)) & (comp[two] != comp[i])
            others = np.unique(comp[two[hit]])
            a.append(np.minimum(others, comp[i]))
            b.append(np.maximum(others, comp[i]))
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
        return pa.Table.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    hopeful = step(_open_pairs(tiles, sketches, threshold), "tiles")
    return hopeful.hint("merge").join(texts.select("rep", "text"), "rep").groupBy("tile").applyInArrow(compare, "a long, b long").distinct()


def _blocks(shingle_count: Column, sets: Column) -> Column:
    return F.greatest(F.ceil(shingle_count / TILE), F.ceil(sets / TILE_SETS), F.lit(1)).cast("int")


def _star_tiles(met: DataFrame, threshold: int) -> DataFrame:
    """Tiles in which members meet their pivot: side 0 is the pivot, side 1 some of the members."""
    pairs = met.filter(f"rep <> pivot and 100 * least(n, pivot_n) >= {threshold} * greatest(n, pivot_n)").select("pivot", "rep", "n").distinct()
    heavy = pairs.groupBy("pivot").agg(_blocks(F.sum("n"), F.count("*")).alias("blocks"))
    dealt = pairs.join(heavy, "pivot").withColumn("tile", F.struct("pivot", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")))
    centres = dealt.select("tile", F.lit(0).alias("side"), F.col("pivot").alias("rep"), F.col("pivot").alias("comp")).distinct()
    return centres.unionByName(dealt.select("tile", F.lit(1).alias("side"), "rep", F.col("rep").alias("comp")))


def _rest_tiles(left: DataFrame) -> DataFrame:
    """Tiles in which those members (key, rep, n, comp) of a key outside its largest component meet all of the key."""
    shares = left.groupBy("key", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    shape = shares.groupBy("key").agg(F.max(F.struct("n", "sets", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("sets").alias("sets"))
    outer = _blocks(F.col("n") - F.col("main.n"), F.col("sets") - F.col("main.sets"))
    shape = shape.select("key", F.col("main.comp").alias("main"), outer.alias("outer"), _blocks(F.col("n"), F.col("sets")).alias("whole"))
    rows = left.join(shape, "key")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = [
        rows.filter("comp <> main").select("key", own("outer").alias("i"), every("whole").alias("j"), F.lit(0).alias("side"), "rep", "comp"),
        rows.select("key", every("outer").alias("i"), own("whole").alias("j"), F.lit(1).alias("side"), "rep", "comp"),
    ]
    return sides[0].unionAll(sides[1]).select(F.struct("key", "i", "j").alias("tile"), "side", "rep", "comp")


def join_ngrams(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Two documents link when 100 * |shared shingles| >= threshold * |all
    shingles|; component_id is the smallest doc_id reachable over links.  A text
    of fewer than k words is one shingle of all of them; a null or empty text,
    or one of white space, has none and links with nothing.  Different texts
    under one doc_id each have a row and link as one document.  A row without
    doc_id takes no part: its component_id is null.  An empty table gives no
    rows; other columns are ignored.
    """
    sets = step(describe(docs, k), "sets")
    known = sets.filter("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "parity")).alias("r"))
    sketches = step(classes.select(F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), "r.parity"), "sketches")
    # ids of classes and tiles grow with the corpus: none is sent to every task, at any size
    reps = sketches.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = step(doc_key(docs).join(reps, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"), "texts")
    keyed = sign(texts, k, threshold)
    # signatures with the same holders count once: two hashes of the holders stand for them
    holders = Window.partitionBy("key")
    marks = [F.expr(f"bit_xor(xxhash64(rep, {s}))").over(holders).alias(f"h{s}") for s in (1, 2)]
    shared = keyed.select("rep", "n", F.count("*").over(holders).alias("size"), *marks).filter("size > 1")
    members = step(shared.distinct().select(F.struct("size", "h1", "h2").alias("key"), "rep", "n", "size"), "members")

    popular = members.groupBy("rep").agg(F.sum("size").alias("pop"))
    ranked = members.join(popular, "rep")
    best = F.max(F.struct("pop", (-F.col("rep")).alias("neg"), "n")).alias("p")
    pivots = ranked.groupBy("key").agg(best).select("key", (-F.col("p.neg")).alias("pivot"), F.col("p.n").alias("pivot_n"))
    met = members.join(pivots, "key")
    links = step(_links(_star_tiles(met, threshold), sketches, texts, k, threshold), "links")
    labels = components(links)

    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    split = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    left = step(named.join(split, "key", "left_semi").select("key", "rep", "n", "comp"), "left")
    more = step(_links(_rest_tiles(left), sketches, texts, k, threshold), "links")
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    least = known.groupBy("fp").agg(F.min("doc_id").alias("node")).join(labels, "node", "left")
    least = least.select("fp", F.coalesce("component", "node").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "fp").join(least, "fp", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
