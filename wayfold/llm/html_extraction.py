"""Main text of web pages: a host's suffix array over all their blocks, with page structure as the prior.

A page is read once into blocks (text between block-level tags), each of a kind: "article"
(in an article or main element), "out" (in menus, headers, footers, side bars, forms, notices,
adverts and reader comments, by element, role, class or id) or "open" (neither).

Host suffix array. The blocks of all pages of a host are streams of text. Each stream falls
into chunks by the minimizer of every RUN-byte string (as in suffix_dedup); a block shorter than
that is one chunk. Equal chunks are one row with the first and last of their pages, combined map-side, so
a footer on a third of all pages has no task of its own. The different chunks of a minimizer are concatenated with separators
and their suffixes sorted in two stages (where a host has more than HOT_BYTES of them, string by string under its hash); neighbours in that order with RUN bytes in common form
groups, and a group covers its strings if they stand on two pages. An article's own text needs far more evidence, since articles quote one another:
ARTICLE_SHARE of the host's pages and ARTICLE_PAGES at least, and its runs are chunks of LONG bytes
that are equal as a whole (found by a 64-bit hash, the minimizer and the size; no bytes are moved).
What is found goes back to the pages that hold such a chunk.

Verdict on each block: covered runs are boilerplate and go, to whole tokens. Of the rest the prior
speaks: article runs stay, out runs go, and open runs stay if the page has no more article text
than open text. n_repeated tells how many bytes of a page the array covered.

Edge cases: null html has empty text; a page of which all repeats has empty text; a null url is
a host; pages that share a page_id are told apart by what they hold, and equal rows are one page to
"distinct pages", each with a row in the result; unclosed elements end with their container or the page;
unknown character references stay as they are; empty tables and empty partitions give empty
results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, table
from wayfold.llm.suffix_dedup import _ragged, chunks
from wayfold.llm.suffixes import common_prefixes, suffix_array
from wayfold.llm.textnp import _CODE, buffers, column, hashes, mix, signed, slices

#: Bytes that a repeated run has at least (some eight words), and that a chunk inside an article is looked at by.
RUN, LONG = 48, 160
#: Share and number of a host's pages that a run inside articles must stand on to be boilerplate; outside, two pages are enough.
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 8
#: A minimizer of a host with more bytes of different chunks is not sorted in one task.
HOT_BYTES = 32 << 20

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|object)\b(?>[^>"']+|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)>
    |<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>
    |<[!?][^>]*>""",
    re.S | re.I | re.X,
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
UNTRACKED = frozenset("p li html body hr".split())
OUT = frozenset("head nav header footer aside form menu dialog button label input".split())
ARTICLE = frozenset("article main".split())
ARTICLE_OUT = frozenset("comment comments reply replies teaser related recommended promo advert sponsored".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
OUT_WORD = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|newsletter|signup|paywall"
    r"|nav\w*|menu\w*|breadcrumbs?|pagination|pager|toolbar|sidebar|side|widgets?|related|recommended|share|sharing|social|footer|header|masthead|comments?|disqus|replies|respond|skip",
    re.I,
)
#: How far an element is out: a name that only has a listed word in it may be a layout's, with the article inside.
MAYBE, SURELY = 1, 2


def _named(value: str, inside: bool) -> int:
    """Whether a class or id says that an element is out; an article's own header is not."""
    out = 0
    for token in value.lower().split():
        words = re.split("[_-]+", token)
        hit = {w for w in words if OUT_WORD.fullmatch(w)} - ({"header", "masthead"} if inside else set())
        if hit:
            out = max(out, SURELY if len(words) == 1 or hit & ARTICLE_OUT else MAYBE)
    return out


#: What the attributes of an inline element that is out have in them.
MARK = re.compile("hidden|role|display", re.I)


def _away(name: str, attrs: str | None, inside: bool) -> int:
    """How far an element is out by what it is, its attributes and, if it is a block, its names."""
    return _away_short(name, attrs, inside) if len(attrs or "") < 256 else _judged(name, attrs, inside)


def _judged(name: str, attrs: str | None, inside: bool) -> int:
    away = SURELY if name in OUT and not (inside and name in ("header", "footer")) else 0
    for key, *value in ATTR.findall(attrs or "") if not away else ():
        key, value = key.lower(), next((v for v in value if v), "")
        if key == "role" and value.lower() in OUT_ROLES or key == "aria-hidden" and value.lower() == "true" or key == "hidden" and value.lower() != "until-found":
            away = SURELY
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            away = SURELY
        elif key == "class" and name in ARTICLE and not ARTICLE_OUT.isdisjoint(value.lower().split()):
            away = SURELY
        elif key in ("class", "id") and name in BLOCK and name not in ARTICLE and name not in ("body", "html"):
            away = max(away, _named(value, inside))
    return away


#: Pages of a host have the same few tags.
_away_short = lru_cache(maxsize=1 << 12)(_judged)


def _rest(page: str, at: int, last: re.Match | None) -> str:
    """The text after the last tag; a comment or script that is never closed has none."""
    if last is not None and (last[0].startswith("<!--") and not last[0].endswith("-->") or last["raw"] and not re.search(rf"</{last['raw']}\s*>\Z", last[0], re.I)):
        return ""
    return page[at:].split("<!--", 1)[0]


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of all blocks in page order; kind is article, out or open.

    An article is in whatever layout names stand around it, but not within what is surely out (comments, asides). Inline
    elements never end a block; hidden ones and buttons are left out of it. Text under a layout's name alone is open if it is most of
    what the page has.
    """
    found: list[tuple[int, bool, str]] = []  # how far out, in an article, text
    stack: list[tuple[str, bool, int, bool]] = []  # element, in an article, how far out, left out inside a block
    parts: list[str] = []
    inside, out, skip = False, 0, False

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            found.append((out, inside, text))

    def back_to(k: int) -> None:
        nonlocal inside, out, skip
        del stack[k:]
        _, inside, out, skip = stack[-1] if stack else ("", False, 0, False)

    def opener(name: str) -> int:
        """Where the element that a closing tag ends stands in the stack, or -1."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                return k
        return -1

    at, m = 0, None
    for m in TAG.finditer(page, 0, page.rfind(">") + 1):  # no tag ends later, so markup that never ends is not looked for again and again
        start, end = m.span()
        if start > at and not skip:
            parts.append(page[at:start])
        at = end
        _, close, name, attrs, close2, name2, attrs2 = m.groups()
        if name2:
            close, name, attrs = close2, name2, attrs2
        elif not name:
            continue
        name = name.lower()
        if name not in BLOCK:
            if name == "br":
                if not skip:
                    parts.append(" ")
            elif close:
                if skip and (k := opener(name)) >= 0:
                    if parts and any(e[0] in BLOCK for e in stack[k:]):
                        flush()
                    back_to(k)
            elif (name in OUT or attrs and MARK.search(attrs)) and name not in VOID and _away(name, attrs, inside):
                stack.append((name, inside, out, True))
                skip = True
            continue
        if parts:
            flush()
        if stack:
            if close or name == "p":  # what is inline ends with its block at the latest
                while stack and stack[-1][0] not in BLOCK:
                    back_to(len(stack) - 1)
            if close:
                if (k := opener(name)) >= 0:
                    back_to(k)
                continue
            if name == "body":
                back_to(0)
            elif stack[-1][0] == "p":  # a block ends an open paragraph
                back_to(len(stack) - 1)
        if close or name in VOID:
            continue
        away = _away(name, attrs, inside) if attrs or name in OUT else 0
        if away or name not in UNTRACKED:
            scope = name in ARTICLE and out < SURELY
            stack.append((name, inside or name in ARTICLE, away if scope else max(out, away), skip))
            _, inside, out, skip = stack[-1]
    if not skip:
        parts.append(_rest(page, at, m))
    flush()
    maybe = sum(len(t) for o, _, t in found if o == MAYBE)
    gone = SURELY if 2 * maybe > sum(len(t) for o, _, t in found if o < SURELY) else MAYBE
    return [("out" if o >= gone else "article" if a else "open", t) for o, a, t in found]


#: The host part of a URL.
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)"


STREAM = "host string, row long, kind byte, val long, hash long, size int, start int"
#: Kinds in STREAM rows: blocks outside articles, where bytes are compared, and inside.
OUTSIDE, INSIDE = 0, 1
_BASE = 0x9E3779B97F4A7C15


def _range_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of byte ranges, which may overlap, from running sums of a polynomial in an odd base."""
    n = len(data)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[data] * power[:n], dtype=np.uint64)))
    return mix((total[start + size] - total[start]) * back[start] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _chunks_of(batch: pa.RecordBatch, kind: int, streams: list[list[tuple[int, str]]]):
    """page, val, hash, size, place in the page's joined text and bytes of all chunks of blocks of one kind."""
    flat = [(page, at, text.encode()) for page, blocks_ in enumerate(streams) for at, text in blocks_]
    data, offsets = buffers(pa.array([x for _, _, x in flat], pa.large_binary()))
    width = RUN if kind == OUTSIDE else LONG
    size = np.diff(offsets)
    val, block, start, length = chunks(data, offsets, width)
    short = np.flatnonzero((size < width) & (size > 0))
    val = np.concatenate((val, hashes(data, offsets[short], offsets[short + 1], lower=False)))
    block, start, length = (np.concatenate(x) for x in ((block, short), (start, np.zeros(len(short), np.int64)), (np.abs(length), size[short])))
    page, place = (np.array([x[i] for x in flat], np.int64) for i in range(2))
    begin = offsets[block] + start
    return page[block], val, _range_hashes(data, begin, length), length, place[block] + start, data, begin


def _placed(page: str | None) -> list[tuple[str, int, str]]:
    """kind, place in bytes (blocks joined by one byte) and text of a page's blocks."""
    out, at = [], 0
    for kind, text in blocks(page or ""):
        out.append((kind, at, text))
        at += len(text.encode()) + 1
    return out


def _occurrences(with_bytes: bool):
    """Chunks of all blocks of pages (row, host, html); with_bytes, those outside articles with their bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "html"):
            pages = [_placed(p) for p in column(batch, "html").to_pylist()]
            for kind in (OUTSIDE,) if with_bytes else (OUTSIDE, INSIDE):
                streams = [[(at, t) for k, at, t in p if (k == "article") == (kind == INSIDE)] for p in pages]
                page, val, hash_, size, start, data, begin = _chunks_of(batch, kind, streams)
                host, row = column(batch, "host").take(pa.array(page)), column(batch, "row").take(pa.array(page))
                if not with_bytes:
                    cols = [host, row, pa.array(np.full(len(page), kind, np.int8)), pa.array(signed(val)), pa.array(signed(hash_)), pa.array(size.astype(np.int32)), pa.array(start.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in STREAM.split(", ")])
                    continue
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[_ragged(begin, size)])])
                yield pa.RecordBatch.from_arrays([host, row, pa.array(signed(val)), pa.array(signed(hash_)), body], names=["host", "row", "val", "hash", "chunk"])

    return run


def covered(parts: list[bytes], first: list[int], last: list[int]) -> list[tuple[int, int, int]]:
    """(chunk, lo, hi) of the runs of RUN bytes or more of different chunks that stand on two pages; first, last: of the pages that hold each chunk."""
    size = np.array([len(p) for p in parts])
    body = np.frombuffer(b"".join(parts), np.uint8)
    text = np.zeros(len(body) + len(parts), np.uint8)
    begin = np.cumsum(size + 1) - (size + 1)
    text[_ragged(begin, size)] = body + np.uint8(1)
    order = suffix_array(text, RUN)
    alike = common_prefixes(text, order, RUN)
    group = np.cumsum(~alike)
    chunk = np.searchsorted(begin, order, "right") - 1
    whole = order + RUN <= begin[chunk] + size[chunk]  # a string of RUN bytes within its chunk
    group, chunk, order = group[whole], chunk[whole], order[whole]
    least, most = np.full(len(text) + 1, 2**63 - 1, np.int64), np.full(len(text) + 1, -(2**63), np.int64)
    np.minimum.at(least, group, np.array(first, np.int64)[chunk])
    np.maximum.at(most, group, np.array(last, np.int64)[chunk])
    hit = np.sort(order[(least < most)[group]])
    out: list[tuple[int, int, int]] = []
    for p in hit.tolist():
        c = int(np.searchsorted(begin, p, "right")) - 1
        lo = p - int(begin[c])
        if out and out[-1][0] == c and lo <= out[-1][2]:
            out[-1] = (c, out[-1][1], lo + RUN)
        else:
            out.append((c, lo, lo + RUN))
    return out


RULES = "host string, kind byte, val long, hash long, lo int, hi int"


def _host_rules(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The covered ranges of chunks, from rows (host, val, hash, chunk, first, last), each different chunk once, sorted by (host, val)."""
    held: list[tuple[int, bytes, int, int]] = []  # hash, bytes, first and last page of the chunks of one (host, val)
    rows: list[tuple] = []
    key = None

    def flush() -> None:
        # a chunk that stands on two pages is covered as a whole; a block shorter than a run can be covered in no other way
        whole = {h[0] for h in held if h[2] < h[3]}
        rows.extend((key[0], OUTSIDE, key[1], h[0], 0, len(h[1])) for h in held if h[0] in whole)
        long = [h for h in held if len(h[1]) >= RUN]
        if len(long) > 1 and min(h[2] for h in long) < max(h[3] for h in long):
            for c, lo, hi in covered([h[1] for h in long], [h[2] for h in long], [h[3] for h in long]):
                if long[c][0] not in whole:
                    rows.append((key[0], OUTSIDE, key[1], long[c][0], lo, hi))
        held.clear()

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in RULES.split(", ")])

    for batch in it:
        for host, val, *rest in zip(*(column(batch, c).to_pylist() for c in ("host", "val", "hash", "chunk", "first", "last")), strict=True):
            if (host, val) != key:
                if held:
                    flush()
                key = (host, val)
            held.append(tuple(rest))
        yield batch_of(rows)
        rows.clear()
    if held:
        flush()
    yield batch_of(rows)


STRINGS = "host string, val long, hash long, string long, lo int, size int, first long, last long"


def _strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of RUN bytes of the chunks of a batch, or the whole of a shorter one, by its hash."""
    for batch in slices(it, "chunk", 1 << 17):
        data, offsets = buffers(column(batch, "chunk"))
        size = np.diff(offsets)
        n = np.maximum(size - RUN, 0) + 1
        of, lo = np.repeat(np.arange(len(size)), n), _ragged(np.zeros(len(size), np.int64), n)
        own = _range_hashes(data, offsets[of] + lo, np.minimum(size, RUN)[of])
        at = pa.array(of)
        cols = [*(column(batch, c).take(at) for c in ("host", "val", "hash")), pa.array(signed(own)), pa.array(lo.astype(np.int32)), pa.array(size[of].astype(np.int32)), *(column(batch, c).take(at) for c in ("first", "last"))]
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in STRINGS.split(", ")])


def unique_runs(text: str, at: int, covers: list[tuple[int, int]]) -> str:
    """A block without the tokens that covers (byte ranges of the page's joined blocks) touch in full; at: where it begins."""
    raw = text.encode()
    gone = np.zeros(len(raw) + 1, bool)
    for lo, hi in covers:
        gone[max(0, lo - at) : max(0, hi - at)] = True
    if not gone.any():
        return text
    return " ".join(m.group().decode() for m in re.finditer(rb"[^ ]+", raw) if not gone[m.start() : m.end()].all())


def main_text(page: str | None, covers: list[tuple[int, int]]) -> tuple[str, int]:
    """The main text of a page and the bytes of it that covers hold."""
    placed = _placed(page)
    gone = np.zeros(sum(len(t.encode()) + 1 for _, _, t in placed) if covers else 0, bool)
    for lo, hi in covers:
        gone[lo:hi] = True
    left = [(kind, unique_runs(text, at, covers) if covers else text) for kind, at, text in placed if kind != "out"]
    size = {k: sum(len(t) for kind, t in left if kind == k) for k in ("article", "open")}
    keep_open = size["open"] > size["article"]
    return "\n\n".join(t for kind, t in left if t and (kind == "article" or keep_open)), int(gone.sum())


TEXTS = "page_id long, url string, text string, n_repeated long"


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it, "html"):
        covers = [[(c["lo"], c["hi"]) for c in x or []] for x in column(batch, "covers").to_pylist()]
        got = [main_text(p, c) for p, c in zip(column(batch, "html").to_pylist(), covers, strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], names=["page_id", "url", "text", "n_repeated"])


#: So many rows of covers (some 60 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated of every row of pages (columns page_id, url, html)."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("row"), host)
    read = pages.select("row", "host", "html")
    found = read.mapInArrow(_occurrences(False), STREAM)
    chunk = ["host", "kind", "val", "hash"]
    # inside articles: chunks that are equal on enough pages of their host
    once = found.where(f"kind = {INSIDE}").select(*chunk, "row").distinct().groupBy(*chunk).agg(F.count(F.lit(1)).alias("pages")).where(f"pages >= {ARTICLE_PAGES}")
    per_host = pages.select("host", "row").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    inside = once.join(per_host, "host").where(F.col("pages") >= F.col("_all") * ARTICLE_SHARE)
    inside = inside.select(*chunk, F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi"))
    # outside: the bytes of each different chunk once, by minimizer, with the first and last of its pages
    bytes_ = read.mapInArrow(_occurrences(True), "host string, row long, val long, hash long, chunk binary")
    different = cut(bytes_.groupBy("host", "val", "hash").agg(F.first("chunk").alias("chunk"), F.min("row").alias("first"), F.max("row").alias("last")))
    hot = cut(different.groupBy("host", "val").agg(F.sum(F.octet_length("chunk")).alias("_b")).where(F.col("_b") > HOT_BYTES).select("host", "val"))
    outside = different.join(hot, ["host", "val"], "left_anti").repartition(parts, "host", "val").sortWithinPartitions("host", "val").mapInArrow(_host_rules, RULES)
    if not hot.isEmpty():  # string by string, each under its own hash
        strings = different.join(hot, ["host", "val"]).mapInArrow(_strings, STRINGS)
        again = strings.groupBy("host", "string").agg(F.min("first").alias("_a"), F.max("last").alias("_b")).where("_a < _b").select("host", "string")
        spelt = strings.join(again, ["host", "string"]).select("host", F.lit(OUTSIDE).cast("byte").alias("kind"), "val", "hash", "lo", F.least(F.col("lo") + RUN, F.col("size")).alias("hi"))
        outside = outside.union(spelt)
    rules = cut(inside.select(*[c.split()[0] for c in RULES.split(", ")]).union(outside))
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_ROWS else rules
    hits = found.join(rules, chunk).select("row", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.coalesce("hi", "size")).alias("hi"))
    covers = cut(hits.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("covers")))
    covers = F.broadcast(covers) if covers.count() <= BROADCAST_ROWS else covers
    out = pages.join(covers, "row", "left").select("page_id", "url", "html", "covers").mapInArrow(_texts, TEXTS)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
