"""Main text of web pages by runs of tokens that repeat on a host.

A page is split into blocks of text, each with the page's own marks: inside an article, inside something that is never main
text (menu, header, footer, sidebar, notice, advert, form, comments), or neither. Runs of MIN_TOKENS tokens that stand on two or
more distinct pages of a host are the host's boilerplate, and what they cover is removed. Unique runs stay. Blocks inside a page's own
article are text by the page's word and stay whole, also where they quote or repeat; outside of it only pages without an article keep
anything.

The distinct runs of each page are counted over all pages of the host, by the hash of host and run, so neither a large host nor a
common run is in one task. Only hosts with a page that doesn't mark its text need that. Runs count as equal if their 64-bit hashes are.

An element that is never text, such as button or svg, goes with all in it; where it isn't closed, only its tag goes. Raw text, such as a
script, that isn't closed reaches to the end of the page, as in browsers.

Cases: a null or empty html gives an empty text; a null url counts as one host; a host with a single page has no repeats, and
only the marks decide; very long pages are used whole; pages with equal html give equal text; an empty table gives an empty
table. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import RollingHash, Workspace, mix64, table

MIN_TOKENS, MIN_PAGES = 8, 2

#: Element names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head template svg object select button datalist canvas audio video map".split())
ASIDE = frozenset("nav aside footer form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"}
#: Roles and words of class and id that mark what isn't main text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices disclaimer menu menubar navbar nav navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar header pageheader siteheader comment comments commentlist disqus respond replies related recommended share sharing social newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar skip".split())
#: Words that only place or shape what they name.
PLAIN = frozenset("box block container wrapper wrap list section area bar item inner outer top bottom left right site page global main primary secondary button buttons link links text slot unit row col column panel module component article post posts entry user reader legal privacy policy print mobile desktop sticky fixed inline js".split())
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>", re.S)
#: A tag whose quotes don't close before the page ends, and how many of them show that a page's quotes mean nothing.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
LOOSE_TAGS = 16
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_TOKEN = re.compile(r"\w+")
_hash = RollingHash(0, 0)


@dataclass
class Block:
    text: str
    article: int  # number of the article it stands in, 0 outside
    main: bool
    out: bool


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def _marked(name: str, source: str, in_article: bool) -> bool:
    """The element isn't main text."""
    if name in ASIDE or name == "header" and not in_article:
        return True
    if not source.strip():
        return False
    have = _attributes(source)
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or have.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", have.get("style", "").lower()):
        return True
    if name in ("body", "html", "article", "main"):
        return False
    names = f"{have.get('class', '')} {have.get('id', '')}".lower().split()
    # inside an article a name must say nothing else: a notice-box, but not a notice-of-meeting
    parts = [[w for w in _SPLIT.split(n) if w and not w.isdigit()] for n in names]
    return any(not WORDS.isdisjoint(p) and (not in_article or all(w in WORDS or w in PLAIN for w in p)) for p in parts)


def closings(source: str, name: str) -> dict[int, int]:
    """Where elements of a name end, by where they start. A closing tag belongs to the last one open; elements without one aren't in it."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    raw = "|".join(sorted(RAW))
    tags = re.compile(rf"<!--.*?(?:--!?>|\Z)|<({raw})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])|\Z)|<(/?){re.escape(name)}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
    for m in tags.finditer(source):
        if m[2]:
            if opened:
                ends[opened.pop()] = m.end()
        elif m[2] is not None and not m[3].rstrip().endswith("/"):
            opened.append(m.start())
    return ends


def blocks(source: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # name, out, article, main, in a header of an article
    state = ("", False, 0, False, False)
    articles = 0
    hidden: dict[str, dict[int, int]] = {}

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, state[2], state[3], state[1]))
            held.clear()

    def leave(depth: int) -> None:
        nonlocal state
        del stack[depth:]
        state = stack[-1] if stack else ("", False, 0, False, False)

    at, n, loose = 0, len(source), 0

    def next_tag(at: int) -> re.Match | None:
        nonlocal loose
        for place in _OPEN.finditer(source, at):
            m = _TAG.match(source, place.start()) if loose < LOOSE_TAGS or source.startswith("<!--", place.start()) else None
            if m is None and (m := _LOOSE.match(source, place.start())) is not None:
                loose += 1
            if m is not None:
                return m
        return None

    while at < n:
        m = next_tag(at)
        if m is None:
            held.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            held.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                held.append(" ")
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0:
                if name in BLOCKS or any(x[0] in BLOCKS for x in stack[depth:]):
                    close()
                leave(depth)
            elif name == "p":
                close()
            continue
        if name in RAW or name in HIDDEN:
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = n if end is None else source.find(">", end.end()) + 1 or n
            else:
                if name not in hidden:
                    hidden[name] = closings(source, name)
                at = hidden[name].get(m.start(), at)  # one that isn't closed hides its tag only
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            elif name in ("br", "wbr"):
                held.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            close()
            if name in CLOSES_P:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
                if depth >= 0 and stack[depth][0] == "p":
                    leave(depth)
            elif name in ("li", "dd", "dt", "td", "th", "tr"):
                peers = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in peers:
                        leave(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "tbody"):
                        break
        if len(stack) > 4000:  # deeper elements keep the state they stand in
            continue
        _, gone, article, main, top = state
        if name == "article" and not article:
            articles += 1
            article = articles
        top = top or name == "header" and article > 0
        gone = gone or _marked(name, m[3], article > 0)
        main = main or name == "main" or 'role="main"' in m[3].lower() or "articlebody" in m[3].lower()
        state = (name, gone, article, main, top)
        stack.append(state)
    close()
    return out


def choose(found: list[Block]) -> list[tuple[int, bool]]:
    """(number, protected) of the blocks that may be main text; protected: the page marks it as its article."""
    live = [i for i, b in enumerate(found) if not b.out]
    if any(found[i].article for i in live):
        return [(i, True) for i in live if found[i].article]
    if any(found[i].main for i in live):
        return [(i, True) for i in live if found[i].main]
    return [(i, False) for i in live]


def token_ids(text: str) -> list[int]:
    return [zlib.crc32(t.lower().encode()) for t in _TOKEN.findall(text)]


def uncovered(text: str, gone: np.ndarray) -> str:
    """The text without the tokens that are gone. What stands between tokens goes with the one before it, or the first one."""
    start = [m.start() for m in _TOKEN.finditer(text)]
    edge = [0, *start[1:], len(text)]
    cut = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return " ".join(x for a, b in cut.reshape(-1, 2).tolist() if (x := text[edge[a] : edge[b]].strip()))


def run_keys(found: list[Block], host: int, length: int = MIN_TOKENS) -> np.ndarray:
    """A hash of each run of `length` tokens of a page, over all its blocks, and of its host."""
    ids = np.array([t for b in found for t in token_ids(b.text)], np.int64)
    start = np.arange(max(0, len(ids) - length + 1))
    return mix64(_hash.span(_hash.prefix(ids), start, start + length) ^ np.uint64(host & (1 << 64) - 1)).view(np.int64)


def _pack(found: list[Block]) -> bytes:
    """All blocks of a page, compressed for the shuffle; control characters separate fields, which text can't hold after split()."""
    import zstandard

    rows = [b"%d\x1f%d\x1f%d\x1f" % (b.article, b.main, b.out) + b.text.encode() for b in found]
    return zstandard.ZstdCompressor(level=3).compress(b"\x1e".join(rows))


def _unpack(data: bytes) -> list[Block]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    rows = (r.split(b"\x1f", 3) for r in raw.split(b"\x1e")) if raw else ()
    return [Block(text.decode(), int(article), main == b"1", out == b"1") for article, main, out, text in rows]


def page_text(found: list[Block], starts: list[int], length: int = MIN_TOKENS) -> str:
    """The text of a page. starts: the tokens, counted over all blocks, where boilerplate of `length` tokens starts."""
    at = np.cumsum([0, *(len(token_ids(b.text)) for b in found)]) if starts else np.zeros(len(found) + 1, np.int64)
    change = np.zeros(int(at[-1]) + 1, np.int32)
    np.add.at(change, np.array(starts, np.int64), 1)
    np.add.at(change, np.array(starts, np.int64) + length, -1)
    covered = np.cumsum(change[:-1]) > 0
    kept = []
    for i, protected in choose(found):
        gone = covered[at[i] : at[i + 1]]
        kept.append(found[i].text if protected or not gone.any() else uncovered(found[i].text, gone))
    return "\n\n".join(x for x in kept if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    ws = Workspace(pages.sparkSession, "op2")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [blocks(h or "") for h in part.column("html").to_pylist()]
                unmarked = [any(not protected for _, protected in choose(f)) for f in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "no")), pa.array(unmarked, pa.bool_()), pa.array([_pack(f) for f in found], pa.binary())], ["page_id", "url", "host", "no", "unmarked", "blocks"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, data in zip(batch.column("host").to_pylist(), batch.column("blocks").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(run_keys(_unpack(data), host)))], ["key"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, host, data in zip(*(batch.column(c).to_pylist() for c in ("no", "host", "blocks"))):
                keys = run_keys(_unpack(data), host)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), no)), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys)], ["no", "at", "key"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(_unpack(data), starts or []) for data, starts in zip(batch.column("blocks").to_pylist(), batch.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"), F.monotonically_increasing_id().alias("no"))
    parsed = ws.save(rows.mapInArrow(parse, f"{kinds}, host long, no long, unmarked boolean, blocks binary"), "pages")
    none = F.lit(None).cast("array<int>").alias("starts")
    unmarked = parsed.where("unmarked")
    if unmarked.isEmpty():
        source = parsed.select("page_id", "url", "blocks", none)
    else:
        near = parsed.select("host", "blocks").join(unmarked.select("host").distinct(), "host", "left_semi")
        # a page gives a run once, so these are counts of pages
        common = near.mapInArrow(runs, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
        found = unmarked.select("no", "host", "blocks").mapInArrow(places, "no long, at int, key long").join(common, "key", "left_semi")
        cut = unmarked.join(found.groupBy("no").agg(F.collect_list("at").alias("starts")), "no", "left")
        source = parsed.where("not unmarked").select("page_id", "url", "blocks", none).unionByName(cut.select("page_id", "url", "blocks", "starts"))
    return source.mapInArrow(write, f"{kinds}, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
