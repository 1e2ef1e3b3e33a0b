"""Sharding, packing, page extraction and the pipeline."""

import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from brute import near
from test_dedup import DOCS, ODD, corpus, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm import packing, sharding, wrapper

PAGES = "page_id long, url string, html string"


def shards_of(rows):
    out = defaultdict(dict)
    for r in rows:
        assert r.slot not in out[r.shard]
        out[r.shard][r.slot] = r.record
    assert all(sorted(s) == list(range(len(s))) for s in out.values())
    return out


def test_shards(spark):
    rows = [(d, t, len((t or "").encode()) + 16) for d, t in corpus(8, 300)] + [(None, "x", 17), (None, "x", 17)]
    docs = spark.createDataFrame(rows, DOCS + ", size long")
    deal = lambda n, **k: sharding.shuffle_shards(docs, "doc_id", "size", n, **k).collect()
    got = deal(5, bucket_bytes=2000)
    assert sorted(got, key=str) == sorted(deal(5, bucket_bytes=2000), key=str)
    assert sorted(map(str, (tuple(r.record) for r in got))) == sorted(map(str, rows))
    shards_of(got)
    shard = {r.record.doc_id: r.shard for r in got}
    grown = {r.record.doc_id: r.grown_shard for r in got}
    more = {r.record.doc_id: r.shard for r in deal(6)}
    assert grown == more and all(more[d] in (shard[d], 5) for d in shard)
    assert 0 < sum(s == 5 for s in more.values()) < len(rows) / 3
    order = [r.record.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == 0 and r.record.doc_id is not None]
    assert order != sorted(order)


def test_shards_odd_inputs(spark, tmp_path):
    odd = spark.createDataFrame([(1, "t", 1, 2, 3, 4)] * 3, "doc_id long, text string, shard int, slot int, bucket int, size int")
    got = shards_of(sharding.shuffle_shards(odd, "doc_id", "size", 3).collect())
    assert sum(map(len, got.values())) == 3 and len(got) == 1
    assert sharding.shuffle_shards(odd.limit(0), "doc_id", "size", 3).isEmpty()
    plain = spark.createDataFrame([(i, "t", 17) for i in range(50)], DOCS + ", size long")
    sharding.write_shards(plain, str(tmp_path / "out"), "doc_id", "size", 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_shards_by_brute_force(spark):
    """Each key's shard is the one whose seeded hash is largest."""
    rows = [(d, "t", 17) for d in [*range(200), -1, 2**40]]
    got = sharding.shuffle_shards(spark.createDataFrame(rows, DOCS + ", size long"), "doc_id", "size", 7, seed=5).collect()

    def score(key, s):
        state = 42
        for value, width in ((5, 4), (s, 4), (key, 8)):
            state = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), state)
        return state - 2**64 if state >= 2**63 else state

    for r in got:
        assert r.shard == max(range(7), key=lambda s: (score(r.record.doc_id, s), s))
        assert r.grown_shard == max(range(8), key=lambda s: (score(r.record.doc_id, s), s))


def test_order_does_not_follow_the_session(spark, monkeypatch):
    """Slots follow the records, the seed and the bucket size: not partitions, not the order of the input, not AQE."""
    docs = spark.createDataFrame([(i, f"t{i}", 100) for i in range(3000)], DOCS + ", size long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}

    def slots(df, partitions, adaptive):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        return {r.record.doc_id: (r.shard, r.slot) for r in sharding.shuffle_shards(df, "doc_id", "size", 4, bucket_bytes=5000).collect()}

    try:
        for single in (sharding.SINGLE_TASKS, 3):  # a task for each bucket, and several buckets in a task
            monkeypatch.setattr(sharding, "SINGLE_TASKS", single)
            first = slots(docs, 4, "true")
            assert len(first) == 3000
            assert first == slots(docs.repartition(5), 7, "false") == slots(docs.orderBy(F.desc("doc_id")), 2, "false")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # within a bucket each place is as likely: neighbours by id are not neighbours by slot
    one = [d for d, _ in sorted(first.items(), key=lambda x: x[1])]
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:], strict=False)) < 30


def test_written_shards_keep_their_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", 100) for i in range(500)], DOCS + ", size long")
    want = {(r.shard, r.slot): r.record.doc_id for r in sharding.shuffle_shards(docs, "doc_id", "size", 3).collect()}
    sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", "size", 3)
    got = {}
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        table = pq.read_table(file, partitioning=None)
        slots = table["slot"].to_pylist()
        assert slots == sorted(slots)
        got |= {(int(file.parent.name.split("=")[1]), s): r["doc_id"] for s, r in zip(slots, table["record"].to_pylist(), strict=True)}
    assert got == want


def test_equal_rows_spread_over_buckets(spark):
    rows = [(i, "t", 100) for i in range(200)] + [(None, "x", 100)] * 150 + [(7, "y", 100)] * 150
    docs = spark.createDataFrame(rows, DOCS + ", size long").repartition(3)
    sizes = sharding.scatter(docs, "doc_id", "size", 4, bucket_bytes=2000).groupBy("shard", "bucket").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) <= 60
    got = sharding.shuffle_shards(docs, "doc_id", "size", 4, bucket_bytes=2000).collect()
    shards_of(got)
    assert sorted(map(str, (tuple(r.record) for r in got))) == sorted(map(str, rows))


def test_best_two_fit():
    """Valid packings, within a hundredth of plain first-fit decreasing on random lengths."""
    rnd = np.random.default_rng(3)
    for high in (20, 100, 60):
        lengths = rnd.integers(1, high + 1, 400)
        sequence, offset = packing.best_two_fit(lengths, 100)
        room = []
        for n in sorted(lengths, reverse=True):
            i = next((i for i, r in enumerate(room) if r >= n), None)
            room.append(100 - n) if i is None else room.__setitem__(i, room[i] - n)
        assert sequence.max() + 1 <= 1.01 * len(room) + 1
        for s in range(sequence.max() + 1):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist() and lengths[own].sum() <= 100


def test_two_smaller_replace_the_smallest():
    # 60 + 30 leaves 10; 30 gives way to 21 + 19, which fill the widened gap of 40
    sequence, _ = packing.best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1]


def test_packed_pieces(spark):
    rows = corpus(9, 150) + [(70_000, "<|endoftext|> in a text"), (70_001, "word " * 9000), (70_002, " 日本語 ½ \r\n")]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), capacity=512, block=40).collect()
    model = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    for d, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = [pieces[d][i] for i in range(len(pieces[d]))]
        assert sum(r.length for r in own) == len(ids) and (len(own) == 1) == (len(ids) <= 512)
        assert all(r.length == 512 for r in own[1:]) and own[0].start == 0
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 512
    assert len(places) <= 1.1 * sum(r.length for r in got) / 512 + 8


def test_packing_odd_inputs(spark):
    odd = spark.createDataFrame([(1, "a b", *"abcd", 1, 2, 3), (1, "a b", *"abcd", 1, 2, 3), (None, None, *"abcd", 1, 2, 3)], ODD)
    got = packing.pack(odd).collect()
    assert len(got) == 3 and len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got)[0] == 0
    assert packing.pack(spark.createDataFrame([], DOCS)).isEmpty()


ARTICLE = [
    ("<article><h1>Title &amp; more</h1><p>One\n  two<br>three</p><p><b>Bold</b> text&nbsp;end", "Title & more\nOne two three\nBold text end"),
    ("<article><header><h1>H</h1></header><p>x<p>y<ul><li>i<li>j</ul><aside>no</aside><footer>no</footer>", "H\nx\ny\ni\nj"),
    ("<article><p>a &lt;b&gt; &#233; &copy</p><form>no</form><script>if (a<b) '</p>'</script><style>p{}</style><p>z", "a <b> é ©\nz"),
    ("<main><div>lead <i>in</i></div><div class='sidebar'>no</div><p>rest</p><section id=comments><p>no</p></section></main>", "lead in\nrest"),
    ("<div class='content'><p>plain body</p><div class=ad>no</div><div role=complementary>no</div></div>", "plain body"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><p>t <!-- no --> u</article><article class='comment'>no</article>", "1\n2\n3\nt u"),
]


@pytest.mark.parametrize(("source", "want"), ARTICLE)
def test_page_content(source, want):
    page = wrapper.parse(f"<!DOCTYPE html><head><title>t</title></head><body><nav>menu</nav><header>site</header>{source}</article><footer>foot</footer>")
    assert wrapper.content(page, "", set()) == want


def test_tree_matching():
    page, other = "html(body(nav article(h1 p) footer))", "html(body(div.ad nav article(h1 ul p)))"
    assert wrapper.match(page, other) == {0: 0, 1: 1, 2: 3, 3: 4, 4: 5, 5: 7}
    assert wrapper.match(page, page) == {i: i for i in range(7)}


@pytest.mark.parametrize("group", ["<dt>term {i}</dt><dd>meaning {i}</dd>", "<h2>head {i}</h2><p>one {i}</p><p>two {i}</p>", "<h3>a {i}</h3><p>b {i}</p><ul><li>c {i}</li></ul>"])
def test_very_many_unlike_siblings(group):
    """Lists of thousands of alternating elements align in time linear in their length, and keep their text."""
    pages = [wrapper.parse(f"<body><h1>title</h1><article>{''.join(group.format(i=i) for i in range(n))}</article></body>") for n in (20_000, 15_000)]
    start = time.perf_counter()
    place = wrapper.match(pages[1].shape, pages[0].shape)
    assert time.perf_counter() - start < 1 and len(place) >= 4 and len(pages[0].shape) < 200
    assert [b[2] for b in pages[1].blocks][1] == re.sub("<[^>]*>", " ", group).format(i=0).split("  ")[0].strip()


def test_constant_blocks_become_template(spark):
    """A line on all pages of a host goes though nothing labels it; copies of one article do not make its text a template."""
    rnd, rows, want = random.Random(11), [], {}
    for i in range(24):
        title = "same story" if i < 14 else f"story {i}"
        body = [prose(random.Random(title), 9), prose(random.Random(title + "b"), 5)]
        nav = "".join(f"<a href=x>{prose(rnd, 1)}</a>" for _ in range(3))
        extra = "<div><p>late addition</p></div>" if i % 5 == 0 else ""
        rows.append((i, "http://a.example/x", f"<title>{title}</title><body><nav>{nav}</nav><div><p>Read our magazine!</p><h2>{title}</h2><p>{body[0]}</p>{extra}<p>{body[1]}</p></div>"))
        want[i] = "\n".join([title, body[0], *(["late addition"] if extra else []), body[1]])
    rows += [(100, None, None), (101, "http://b.example", ""), (102, "not a url", "<p>alone</p>"), (102, "not a url", "<p>alone</p>")]
    want |= {100: "", 101: "", 102: "alone"}
    got = wrapper.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)


WHOLE = [
    ("<div style='overflow:hidden' aria-hidden=false data-id=header data-role=banner><article><p>a</p></article></div>", "a"),
    ("<div class='page with-sidebar'><article><p>a</p><section id='related-work'><p>b</p></section></article></div><div class=sidebar>no</div>", "a\nb"),
    ("<div class=has-sidebar><p>a</p></div><div class='site-footer'>no</div><div hidden>no</div>", "a"),
    ("<main><h1>t</h1><p>lead</p><article><p>a</p></article><p>end</p></main>", "t\nlead\na\nend"),
    ("<p>skip</p><h1>t</h1><p>lead</p><article><p>a story of some length</p></article><p>no</p>", "t\nlead\na story of some length"),
    ("<div><p>the story itself</p><p>and its end</p></div><article>teaser</article>", "the story itself\nand its end\nteaser"),
    ("<form id=aspnetForm><nav><a href=x>no</a></nav><h1>t</h1><p>a</p><footer>no</footer></form>", "t\na"),
    ("<div class=sidebar><div class=overlay><article><p>a story</p></article></div></div><div class=ad>no</div>", "a story"),
    ("<article><p>a</p></article><section class=comments><article><p>no, longer than the story</p></article></section>", "a"),
]


@pytest.mark.parametrize(("source", "want"), WHOLE)
def test_labels_are_evidence_only(source, want):
    assert wrapper.content(wrapper.parse(f"<title>t</title><body><nav><a href=x>menu</a></nav>{source}"), "", set()) == want


def test_varying_furniture_stays(spark):
    """What a class calls a notice or a header stays where it differs from page to page, and goes where it does not; adverts go."""
    rnd, rows, want = random.Random(12), [], {}
    for i in range(12):
        body = [prose(rnd, 6) + f" {i}" for _ in range(3)]
        lost = f"<div class=ad>{prose(rnd, 1)}</div><div class=popup>Join us</div><div class=aside-free>Call us now</div>"
        rows.append((i, "http://c.example/x", f"<title>{i}</title><div><h2>{i}</h2><div class=notice><p>{body[0]}</p></div><p>{body[1]}</p>{lost}<p>{body[2]}</p></div>"))
        want[i] = "\n".join([str(i), *body])
    got = wrapper.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("title", ["", "<title>Our site</title>"])
def test_template_without_titles(spark, title):
    """Pages count by their content where titles do not tell them apart; copies with another date still count once."""
    rnd, rows, want = random.Random(13), [], {}
    story = prose(rnd, 30)
    for i in range(40):
        body = story if i < 34 else prose(rnd, 30) + f" {i}"
        rows.append((i, "http://d.example/x", f"{title}<div><p>Read our magazine!</p><p>{i} May</p><p>{body}</p></div>"))
        want[i] = f"{i} May\n{body}"
    got = wrapper.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("depth", [150, 300, 30_000])
def test_deep_pages(depth):
    """End tags of deep elements close what they opened, and labels count at any depth."""
    deep = "<div>" * depth + "<p>a</p><div class=ad><div><p>no</p></div></div>" + "</div>" * depth
    page = wrapper.parse(f"<title>t</title><body><div><article>{deep}<p>b</p></article></div><p>no</p>")
    assert wrapper.content(page, "", set()) == "a\nb"
    assert wrapper.match(page.shape, page.shape) == {i: i for i in range(len(wrapper.outline(page.shape)))}


def test_pages_odd_inputs(spark):
    odd = spark.createDataFrame([(1, "http://x/y", "<p>" * 3000 + "deep" + "<i a='" * 2000, "h", "t")], PAGES + ", host string, template string")
    assert [r.text for r in wrapper.extract(odd).collect()][0].startswith("deep")
    assert wrapper.extract(spark.createDataFrame([], PAGES)).isEmpty()


def test_pipeline_stages(spark):
    """Each stage on its own input, against plain answers; the columns stay those of documents."""
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = stage["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and 0.5 * len(rows) < len(ids(clean)) <= len(rows)
    largest = {}
    for d, t in rows.items():
        largest[t] = max(d, largest.get(t, -1))
    assert ids(stage["exact_dedup"](spark, docs, sf)) == set(largest.values())
    groups = near(list(rows.items()), 5, 80)
    assert ids(stage["near_dedup"](spark, docs, sf)) == {d for d, (_, c) in groups.items() if c == d}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = ids(stage["decontamination"](spark, docs, sf))
    assert not any(i in rows[d] for d in kept for i in items) and len(kept) > 0.9 * len(rows)
    assert ids(stage["packing"](spark, docs, sf)) == set(rows)


def test_pipeline_keeps_its_stages_whole(spark):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {"doc_id", "sequence_id", "offset"} <= set(packed[0].asDict())
    assert len({r.doc_id for r in packed}) < 200 and sum(r.length for r in packed) > 10_000
