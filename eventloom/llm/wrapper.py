"""Main text of web pages by wrapper induction.

Pages become small trees of block elements; runs of like siblings count once,
so a site's pages share few shapes.  Per host, the commonest shape is the
reference, and simple tree matching aligns every other shape with it.  Over all
pages of the host, an aligned node whose text stays the same on most pages that
differ is template; of the slots that vary, those in the page's content region are the
main text.

Labels (elements, roles, names of classes) are evidence only.  What is labelled
as furniture, such as a footer or a notice, stays where the host's pages show
that its slot varies; menus, adverts and comments vary by nature and go.  No
label counts on a container of the page's main heading, main element or only
articles that holds half of the page's varying prose.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: A text is template where it stands on this share of a host's different pages, and on this many.
SHARE, LEAST = 0.8, 5
#: Unlike siblings from which on repeating patterns of them, of so many labels at most, are one of each.
MANY, PATTERN = 64, 6
#: Pages differ if their titles do, or the longest blocks that together make up this share of their text.
SAME = 0.9
#: Labelled elements inside each other that are told apart; deeper ones go by those around them.
NESTED = 100

# Elements of HTML by their role, and the words sites use to label what is not the article.
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg object canvas math xmp noembed noframes".split())
EMPTY = frozenset("hr".split())
# What differs from page to page without being the article, and what a site repeats.
EXTRA_TAGS = frozenset("head nav aside menu select optgroup option button".split())
FIXED_TAGS = frozenset("footer form dialog fieldset search".split())
EXTRA_ROLES = frozenset("navigation complementary menu menubar toolbar".split())
FIXED_ROLES = frozenset("banner contentinfo search form dialog alert alertdialog".split())
EXTRA_WORDS = frozenset(
    "nav navbar navigation menu sidebar ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored comment comments disqus breadcrumb "
    "breadcrumbs social share sharing related recommended widget widgets toolbar pagination".split()
)
FIXED_WORDS = frozenset(
    "footer header banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay login signup search masthead skip".split()
)
ASIDE_WORDS = EXTRA_WORDS | FIXED_WORDS
OWN_WORDS = frozenset("article post entry content main story".split())
#: Words that leave the meaning of a name with an aside word as it is ("site-footer"); any other ("with-sidebar", "related-work") takes it away.
PLAIN_WORDS = OWN_WORDS | frozenset(
    "articles posts entries stories site page global top bottom left right inner outer upper lower primary secondary mobile desktop box bar block container wrapper wrap area "
    "section list links link item items slot unit panel group row col column text inline button buttons icon icons google js the".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*+)>|</?[a-zA-Z!?][^>]*(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    label: str
    region: int  # 1 inside an article or main content, 0 elsewhere
    children: list[Node] = field(default_factory=list)
    number: int = -1


@dataclass
class Page:
    """A parsed page: its shape, and its text blocks as (node number in the shape, characters outside links, text)."""

    shape: str
    title: str
    blocks: list[tuple[int, int, str]]


def _named(names: str) -> tuple[set[str], set[str]]:
    """Of the names in a class or id: all listed words, and the aside words of names that say nothing else."""
    known, aside = set(), set()
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        known |= words & (ASIDE_WORDS | OWN_WORDS)
        if words <= ASIDE_WORDS | PLAIN_WORDS:
            aside |= words & ASIDE_WORDS
    return known, aside


@lru_cache(maxsize=65536)
def _label(tag: str, attrs: str, outside: bool) -> str:
    """The label of an element in shapes: tag and listed words, then "+" and its kinds: x (extra), f (furniture), r (main or article)."""
    found: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        found.setdefault(k.lower(), v.strip("\"'"))
    (known, aside), (more, also) = _named(found.get("class", "")), _named(found.get("id", ""))
    words, aside = known | more, aside | also
    if words & OWN_WORDS and not aside & {"comment", "comments", "ad", "ads", "related"}:
        aside = set()
    roles = set(found.get("role", "").lower().split()[:1])
    kind = ""
    if tag not in ("html", "body", "main"):
        if tag in EXTRA_TAGS or roles & EXTRA_ROLES or "hidden" in found or aside & EXTRA_WORDS:
            kind = "x"
        elif tag in FIXED_TAGS or roles & FIXED_ROLES or aside or (tag == "header" and outside):
            kind = "f"
    if tag in ("article", "main") or "main" in roles:
        kind += "r"
    return ".".join([tag, *sorted(words)]) + (f"+{kind}" if kind else "")


def _open(parent: Node, tag: str, attrs: str) -> Node:
    label = _label(tag, attrs if "=" in attrs or "hidden" in attrs.lower() else "", parent.region == 0)
    node = Node(tag, label, max(parent.region, int(label.partition("+")[2].endswith("r"))))
    parent.children.append(node)
    return node


def parse(text: str) -> Page:
    """Reads a page leniently: unclosed, stray and cut-off tags are as harmless as in a browser."""
    root = Node("", "", 0)
    stack, parts, blocks, title = [root], [], [], ""
    linked, standing = False, {}

    def flush() -> None:
        if parts:
            line = " ".join("".join(x for x, _ in parts).split())
            if line:
                blocks.append((stack[-1], sum(len(x) for x, link in parts if not link and not x.isspace()), line))
            parts.clear()

    def close(names: set[str], stop: set[str]) -> None:
        if not any(standing.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for n in stack[i:]:
                    standing[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    at = 0
    while True:
        m = _TOKEN.search(text, at)
        end = m.start() if m else len(text)
        if end > at:
            parts.append((html.unescape(text[at:end]), linked))
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m["end"]:
            if not m["attrs"].endswith("/") or tag not in ("svg", "math"):
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(text, at)
                inner_end = stop.start() if stop else len(text)
                if tag == "title" and not title:
                    title = " ".join(html.unescape(text[at:inner_end]).split())
                at = inner_end
            parts.append((" ", linked))
        elif tag == "br":
            parts.append((" ", linked))
        elif tag == "a":
            linked = not m["end"]
        elif tag in BLOCKS:
            flush()
            if m["end"]:
                close({tag}, set())
                continue
            if len(stack) > 1 and stack[-1].tag == "p":
                close({"p"}, set())
            if tag in CLOSES:
                close(CLOSES[tag], SCOPES[tag])
            if tag in ("html", "head", "body"):
                close({"head"}, set())
                if standing.get(tag):
                    continue
            if stack[-1].tag == "head" and tag != "head":
                close({"head"}, set())
            node = _open(stack[-1], tag, m["attrs"])
            if tag not in EMPTY:
                stack.append(node)
                standing[tag] = standing.get(tag, 0) + 1
    flush()
    shape = _shape(root)
    return Page(shape, title, [(n.number, own, line) for n, own, line in blocks])


def _rows(siblings: list[Node]) -> Iterator[list[Node]]:
    """Siblings that are one node of a shape: like ones in a row; in a list of very many, also those of a pattern that repeats."""
    rows = [list(g) for _, g in groupby(siblings, lambda n: n.label)]
    if len(rows) <= MANY:
        return iter(rows)
    labels, out, at = [r[0].label for r in rows], [], 0
    while at < len(rows):
        width, times = 1, 1
        for p in range(2, PATTERN + 1):
            n = at + p
            while n < len(rows) and labels[n] == labels[n - p]:
                n += 1
            if (n - at) // p >= 3 and (n - at) // p * p > width * times:
                width, times = p, (n - at) // p
        out += [[x for r in rows[at + i : at + width * times : width] for x in r] for i in range(width)]
        at += width * times
    return iter(out)


def _shape(root: Node) -> str:
    """The tree as text, numbering its nodes."""
    out, count = [], 0
    todo = [_rows(root.children)]
    while todo:
        nodes = next(todo[-1], None)
        if nodes is None:
            todo.pop()
            out.append(")" if todo else "")
            continue
        out.append((" " if out and out[-1] != "(" else "") + nodes[0].label)
        merged = []
        for n in nodes:
            n.number = count
            merged += n.children
        count += 1
        if merged:
            out.append("(")
            todo.append(_rows(merged))
    return "".join(out)


def _tree(shape: str) -> list:
    """A shape as nested [label, number, children]."""
    top: list = []
    stack, count = [top], 0
    for m in re.finditer(r"[^\s()]+|[()]", shape):
        if m[0] == "(":
            stack.append(stack[-1][-1][2])
        elif m[0] == ")":
            stack.pop()
        else:
            stack[-1].append([m[0], count, []])
            count += 1
    return top


@lru_cache(maxsize=4096)
def match(shape: str, reference: str) -> dict[int, int]:
    """Simple tree matching: node of `shape` -> node of `reference`, a largest order-preserving match of like nodes."""
    if shape == reference:
        return {i: i for i in range(len(re.findall(r"[^\s()]+", shape)))}

    def align(left: list, right: list) -> Generator:
        best = [[(0, ())] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, a in enumerate(left, 1):
            for j, b in enumerate(right, 1):
                top = max(best[i - 1][j], best[i][j - 1], key=lambda x: x[0])
                if a[0] == b[0]:
                    score, inner = yield a[2], b[2]
                    before = best[i - 1][j - 1]
                    if before[0] + score + 1 > top[0]:
                        top = (before[0] + score + 1, (before[1], (a[1], b[1]), inner))
                best[i][j] = top
        return best[-1][-1]

    # the calls of `align` in each other, kept in a list: pages nest deeper than Python does
    calls, back = [align(_tree(shape), _tree(reference))], None
    while calls:
        try:
            calls.append(align(*calls[-1].send(back)))
            back = None
        except StopIteration as done:
            calls.pop()
            back = done.value
    pairs: dict[int, int] = {}
    todo = [back[1]]
    while todo:
        item = todo.pop()
        if item:
            before, (a, b), inner = item
            pairs[a] = b
            todo += [before, inner]
    return pairs


@dataclass(frozen=True)
class Place:
    """Where a node of a shape stands: its tag, whether main content, and the labelled nodes (number, kinds) from the outermost to itself."""

    tag: str
    region: bool
    marks: tuple[tuple[int, str], ...]


@lru_cache(maxsize=4096)
def outline(shape: str) -> list[Place]:
    """The nodes of a shape by number."""
    out, above = [], [Place("", False, ())]
    for m in re.finditer(r"[^\s()]+|[()]", shape):
        if m[0] == "(":
            above.append(out[-1])
        elif m[0] == ")":
            above.pop()
        else:
            name, _, kinds = m[0].partition("+")
            mark = ((len(out), kinds[0]),) if kinds[:1] in ("x", "f") and len(above[-1].marks) < NESTED else ()
            out.append(Place(name.partition(".")[0], above[-1].region or kinds.endswith("r"), above[-1].marks + mark))
    return out


def _opened(nodes: list[Place], blocks: list[tuple[int, int, str]]) -> set[int]:
    """The labelled nodes that are containers of the page's content, by the prose of `blocks` in them."""
    inside: dict[int, int] = {}
    for number, own, _ in blocks:
        for mark, _ in nodes[number].marks:
            inside[mark] = inside.get(mark, 0) + own
    total, opened = sum(b[1] for b in blocks), set()
    if not any(inside.values()):
        return opened
    outside = any(nodes[b[0]].region and not nodes[b[0]].marks for b in blocks)
    for number, node in enumerate(nodes):
        if node.marks and node.marks[-1][0] != number and (node.tag == "main" or (node.tag in ("h1", "article") and not outside)):
            for mark, _ in reversed(node.marks):
                if inside.get(mark, 0) * 2 < total or not inside.get(mark):
                    break
                opened.add(mark)
    return opened


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _hash(texts: list[str]) -> list[int]:
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False).view(np.int64).tolist() if texts else []


PARSED = "host string, shape string, page long, nodes array<int>, texts array<long>"
PLACES = "host string, shape string, place array<int>, fixed array<boolean>"


def _identity(page: Page) -> str:
    """What tells a page of a host from another: its title, and the longest blocks of its content."""
    blocks = sorted({b[2] for b in _region(outline(page.shape), page.blocks, [False] * len(page.blocks)) or page.blocks}, key=lambda x: (-len(x), x))
    total, long = sum(map(len, blocks)), 0
    for n, text in enumerate(blocks):
        if long >= SAME * total:
            return "\n".join([page.title, *blocks[:n]])
        long += len(text)
    return "\n".join([page.title, *blocks])


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, template, varying) of each host.

    The reference shape, the constant texts as "node:hash", and the nodes below
    furniture labels most of whose texts stand on fewer than LEAST pages.
    Pages that do not differ count as one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [parse(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([p.shape for p in rows], pa.string()),
                        pa.array(_hash([_identity(p) for p in rows]), pa.int64()),
                        pa.array([[b[0] for b in p.blocks] for p in rows], pa.list_(pa.int32())),
                        pa.array([_hash([b[2] for b in p.blocks]) for p in rows], pa.list_(pa.int64())),
                    ],
                    ["host", "shape", "page", "nodes", "texts"],
                )

    parsed = written(pages.select(_host().alias("host"), "html").mapInArrow(read, PARSED), "parsed")
    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"))
    reference = shapes.groupBy("host").agg(F.max(F.struct("n", "shape"))["shape"].alias("reference"))
    differing = parsed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))

    def aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [match(s, r) for s, r in zip(frame["shape"], frame["reference"], strict=True)]
            # nodes outside the reference keep a place of their own, after its nodes
            placed = [[p.get(i, 1_000_000 + i) for i in range(len(re.findall(r"[^\s()]+", s)))] for p, s in zip(pairs, frame["shape"], strict=True)]
            fixed = [[any(kind == "f" for _, kind in n.marks) for n in outline(s)] for s in frame["shape"]]
            yield pd.DataFrame({"host": frame["host"], "shape": frame["shape"], "place": placed, "fixed": fixed})

    places = shapes.join(reference, "host").select("host", "shape", "reference").mapInPandas(aligned, PLACES)
    at = lambda column: F.transform("nodes", lambda n: F.get(column, n))
    zipped = F.arrays_zip(at("place").alias("node"), at("fixed").alias("fixed"), F.col("texts").alias("text"))
    texts = parsed.join(places, ["host", "shape"]).select("host", "page", F.explode(zipped).alias("b"))
    seen = texts.select("host", "page", "b.node", "b.fixed", "b.text").distinct().groupBy("host", "node", "fixed", "text").agg(F.count("*").alias("under"))
    slots = seen.filter("fixed").groupBy("host", "node").agg(F.sum("under").alias("all"), F.sum(F.when(F.col("under") < LEAST, F.col("under"))).alias("own"))
    varying = slots.filter(F.col("all") >= LEAST).filter(F.col("own") * 2 >= F.col("all")).groupBy("host").agg(F.collect_list("node").alias("varying"))
    constant = seen.filter(F.col("under") >= LEAST).join(differing, "host").filter(F.col("under") >= SHARE * F.col("pages"))
    # at most 1 / SHARE texts per node of a host pass
    template = constant.groupBy("host").agg(F.collect_set(F.concat_ws(":", "node", "text")).alias("template"))
    return written(reference.join(template, "host", "left").join(varying, "host", "left"), "wrappers")


def content(page: Page, reference: str, template: set[str], varying: frozenset[int] = frozenset()) -> str:
    """The varying blocks of the page's content region, one per line."""
    blocks, slots = page.blocks, [False] * len(page.blocks)
    if template or varying:
        place = match(page.shape, reference)
        at = [place.get(b[0], 1_000_000 + b[0]) for b in blocks]
        stay = [f"{n}:{h}" not in template for n, h in zip(at, _hash([b[2] for b in blocks]), strict=True)]
        slots = [n in varying for n, yes in zip(at, stay, strict=True) if yes]
        blocks = [b for b, yes in zip(blocks, stay, strict=True) if yes]
    return "\n".join(b[2] for b in _region(outline(page.shape), blocks, slots))


def _region(nodes: list[Place], blocks: list[tuple[int, int, str]], slots: list[bool]) -> list[tuple[int, int, str]]:
    """Of `blocks`, those of the content region; `slots` are true where the host shows that furniture varies."""
    opened = _opened(nodes, blocks)
    left = [{kind for mark, kind in nodes[b[0]].marks if mark not in opened} for b in blocks]
    sure = [not kinds for kinds in left]
    kept = [yes or (kinds == {"f"} and varies) for yes, kinds, varies in zip(sure, left, slots, strict=True)]
    core = [yes and nodes[b[0]].region for yes, b in zip(sure, blocks, strict=True)]
    prose = lambda which: sum(b[1] for b, yes in zip(blocks, which, strict=True) if yes)
    if any(core) and prose(core) * 2 >= prose(sure):
        start = core.index(True)
        heads = [i for i, b in enumerate(blocks) if sure[i] and nodes[b[0]].tag == "h1"]
        # a heading before the region, and what leads from it to the region
        lead = heads[0] if heads and not any(core[i] for i in heads) else start
        kept = [yes and (nodes[b[0]].region or (lead <= i < start and sure[i])) for i, (b, yes) in enumerate(zip(blocks, kept, strict=True))]
    return [b for b, yes in zip(blocks, kept, strict=True) if yes]


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    The content region is the main and article elements, with a heading before
    them, where these hold half of the page's varying prose (text outside
    links), else the body.  A block is the text directly in one block element between child blocks, with
    white space (line breaks included) as one space.  Null and empty pages give
    an empty text.  A null or odd url has host "".  Repeated rows are extracted
    like any other but count as one page, so copies of a page never make its
    text a template.  An empty table gives no rows; other columns are ignored.
    """
    wrappers = induce(pages)
    own = pages.select("page_id", "url", "html", _host().alias("host")).join(wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [
                    content(parse(source or ""), reference or "", set(template or ()), frozenset(varying or ()))
                    for source, reference, template, varying in zip(*(part.column(c).to_pylist() for c in ("html", "reference", "template", "varying")), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return own.select("page_id", "url", "html", "reference", "template", "varying").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
