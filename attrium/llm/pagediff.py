"""Main text of web pages: differences between pages with neighbouring URLs, checked against markup.

A page becomes a list of blocks. Pages are sorted by host and URL path; each is paired with the nearest of
its neighbours that is no copy of it, their blocks are aligned by longest common subsequence, and blocks that
both have are deleted. Markup is the check that follows, for what two pages can't show: a shared block stays
if it is a paragraph or heading of the page's <article> or <main> (hosts repeat passages within articles, and
such a passage is no template), and a block that no neighbour has goes if markup says that it is none of the
article (a menu made for one page, say).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import append_columns, slices, stored

#: Elements that end a block, that have no content, whose content is raw text, that are never
#: main text, and words in class, id or role that mark what isn't.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NEVER = frozenset("head title script style noscript template iframe noembed noframes nav footer aside form button select textarea option dialog menu object svg canvas audio video map datalist".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments reply replies respond disqus discussion pagination pager toolbar skip contentinfo complementary search".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

# every part is possessive and may end with the page, so that no character is read twice
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"\s+")
#: kinds of block
CHROME, OPEN, BODY = 0, 1, 2


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if "=" not in attributes or tag in ("html", "body", "article", "main"):
        return False
    words = " ".join(m[2].strip("\"'") for m in ATTRIBUTE.finditer(attributes))
    return any(w in MARKS for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower()))


@dataclass(slots=True)
class _Open:
    """An element that isn't closed yet; what it says holds within it."""

    tag: str
    chrome: bool
    inside: bool  # the article
    content: bool  # a paragraph, heading or the like
    block: int  # place in the stack of the nearest element around it, or itself, that is a block; -1: none


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text and kind of each block of a page, in time that grows with its length. CHROME: markup says that it
    isn't main text, or it stands outside the page's <article> or <main>; BODY: paragraphs and headings
    within; OPEN: anything else."""
    page = page or ""
    out: list[tuple[str, int, bool]] = []
    stack: list[_Open] = []
    count: Counter[str] = Counter()  # of each tag in the stack
    text: list[str] = []
    pos = 0

    def end_block() -> None:
        if text:
            if line := SPACE.sub(" ", entities.unescape("".join(text))).strip():
                top = stack[-1] if stack else None
                kind = OPEN if top is None else CHROME if top.chrome else BODY if top.inside and top.content else OPEN
                out.append((line, kind, top is not None and top.inside))
            text.clear()

    def close(at: int) -> None:
        count.subtract(e.tag for e in stack[at:])
        del stack[at:]

    while m := TOKEN.search(page, pos):
        if m.start() > pos:
            text.append(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                end_block()
            if count[tag] > 0:
                at = len(stack) - 1
                while stack[at].tag != tag:
                    at -= 1
                if stack[-1].block >= at:
                    end_block()
                close(at)
            continue
        if tag in BLOCKS:
            end_block()
            while stack and (at := stack[-1].block) >= 0 and tag in CLOSED_BY.get(stack[at].tag, ()):
                close(at)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        top = stack[-1] if stack else _Open("", False, False, False, -1)
        attributes = m[3] or ""
        marked = (tag in BLOCKS or tag in NEVER or "=" in attributes) and _marked(tag, attributes, top.inside)
        if marked:
            end_block()
        inside = top.inside or (tag in ("article", "main") and not (top.chrome or marked))
        stack.append(_Open(tag, top.chrome or marked, inside, top.content or tag in CONTENT, len(stack) if tag in BLOCKS else top.block))
        count[tag] += 1
    if pos < len(page):
        text.append(page[pos:])
    end_block()
    has_main = any(inside for _, kind, inside in out if kind != CHROME)
    return [(line, CHROME if has_main and not inside else kind) for line, kind, inside in out]


def _signed_hash(line: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))).astype(np.int64))


FULL = 1 << 28  # cells of an alignment, a bit each, that are kept at a time


def _masks(b: list[int]):
    """A function of a line: the bits of the places where b has it."""
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    room, known = FULL // max(1, len(b)), {}

    def mask(x: int) -> int:
        if (found := known.get(x)) is None:
            bits = bytearray(len(b) // 8 + 1)
            for j in at.get(x, ()):
                bits[j >> 3] |= 1 << (j & 7)
            found = int.from_bytes(bits, "little")
            if len(known) < room:
                known[x] = found
        return found

    return mask


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a: bit j is 0 where b[: j + 1] gives a longer common subsequence than b[:j]. The
    whole row is one integer, so a step is a few operations on all of b."""
    mask, full = _masks(b), (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & mask(x)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """The places in a of one longest common subsequence. Where the rows take too much room, a is halved and
    b is cut where both halves together are longest."""
    if not a or not b:
        return []
    if len(a) * len(b) > FULL and len(a) > 1:
        mid = len(a) // 2
        cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
        return _aligned(a[:mid], b[:cut]) + [mid + i for i in _aligned(a[mid:], b[cut:])]
    size = len(b) // 8 + 1
    rows = [row.to_bytes(size, "little") for row in _rows(a, b)]
    grows = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if not grows(i, j):
            j -= 1
        elif i and grows(i - 1, j):
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def lcs(a: list[int], b: list[int]) -> list[bool]:
    """Which of a stand in one longest common subsequence of a and b. Common ends and lines that the other
    lacks are set aside first; the rest takes a step of len(b) / 64 machine words for each line of a."""
    keep = [False] * len(a)
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        keep[lo] = True
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        keep[hi_a] = True
    both = set(a[lo:hi_a]) & set(b[lo:hi_b])
    if both:
        at = [i for i in range(lo, hi_a) if a[i] in both]
        for i in _aligned([a[i] for i in at], [x for x in b[lo:hi_b] if x in both]):
            keep[at[i]] = True
    return keep


def _shared_path(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


OUTLINE = pa.schema([("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
NEAR = 2  # neighbours on each side that may serve
GROUP = 256  # pages of an ordered run that are compared in one group


def _outline(pages: list) -> list:
    """Hashes of the blocks, and their lengths (0 for chrome, which says nothing on whether a page is a copy)."""
    each = [blocks(p) for p in pages]
    return [[[_signed_hash(x) for x, _ in lines] for lines in each], [[len(x) if kind != CHROME else 0 for x, kind in lines] for lines in each]]


def _shared(lines: list[int], sizes: list[int], path: str, around: list[tuple[str, list[int]]]) -> list[int]:
    """The blocks that a page shares with the nearest neighbour (by path; the first given among equals) that
    is no copy of it: a copy has over half of the page's text outside chrome."""
    for _, other in sorted(around, key=lambda x: -_shared_path(path, x[0])):
        keep = lcs(lines, other)
        if 2 * sum(s for s, k in zip(sizes, keep, strict=True) if k) <= sum(sizes):
            return [x for x, k in zip(lines, keep, strict=True) if k]
    return []


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """key and gone of the pages of one group; rows of `own` false only serve as neighbours."""
    rows = rows.sort_values("at").reset_index(drop=True)
    at, hosts, paths = rows["at"].tolist(), rows["host"].tolist(), rows["path"].tolist()
    lines = [x.tolist() for x in rows["lines"]]
    out = []
    for i in np.flatnonzero(rows["own"]).tolist():
        sides = [j for d in range(1, NEAR + 1) for j in (i - d, i + d) if 0 <= j < len(at) and hosts[j] == hosts[i]]
        if lines[i] and (gone := _shared(lines[i], rows["sizes"][i].tolist(), paths[i], [(paths[j], lines[j]) for j in sides])):
            out.append((rows["key"][i], sorted(set(gone))))
    return pd.DataFrame(out, columns=["key", "gone"])


def _host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def in_order(pages: DataFrame) -> DataFrame:
    """key, host, path and at: the number of each page in the order of host, path and key."""
    ordered = pages.select("key", "host", "path").distinct().repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    ordered = stored(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "ordered")
    by = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("pos").alias("first")).select("part", "first", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(before), "part").select("key", "host", "path", (F.col("pos") - F.col("first") + F.col("before")).alias("at"))


def shared_blocks(pages: DataFrame) -> DataFrame:
    """pages: key, url, html. Returns key and gone: hashes of the blocks that a page shares with its pair.

    The order is cut into runs of GROUP pages; each run also gets the NEAR pages before and after it. So a
    host of any size falls into groups of one size, and a group holds outlines, never pages."""
    host, path = _host_path(F.col("url"))
    rows = pages.select("key", F.xxhash64(host).alias("host"), path.alias("path"), "html")
    outlines = append_columns(rows.select("key", "html"), F.col("html"), _outline, OUTLINE).drop("html")
    outlines = outlines.groupBy("key").agg(*[F.first(c).alias(c) for c in OUTLINE.names])  # rows alike are one page
    placed = in_order(rows).join(outlines, "key")
    groups = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - NEAR) / GROUP)), F.floor((F.col("at") + NEAR) / GROUP))
    placed = placed.select("*", F.explode(groups).alias("group")).withColumn("own", F.col("group") == F.floor(F.col("at") / GROUP))
    return placed.groupBy("group").applyInPandas(_compared, "key long, gone array<long>")


def main_text(page: str | None, gone: set[int]) -> tuple[str, int, int, int]:
    """Text of a page, and how many of its blocks were deleted as shared, kept though shared (they are of the
    article's body), and deleted by markup alone."""
    kept, shared, restored, marked = [], 0, 0, 0
    for line, kind in blocks(page):
        is_shared = bool(gone) and _signed_hash(line) in gone
        if is_shared and kind != BODY:
            shared += 1
        elif kind == CHROME:
            marked += 1
        else:
            restored += is_shared
            kept.append(line)
    return " ".join(kept), shared, restored, marked


TEXT = "page_id long, url string, text string, n_chars long, n_shared long, n_restored long, n_marked long"


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages, from its whole html; then how many blocks the
    difference deleted (n_shared), the check kept though shared (n_restored), and the check deleted
    (n_marked).

    A null or empty html has the empty text. Pages without a neighbour on their host keep all that markup
    leaves open. Rows alike in these three columns are one page to their neighbours; null ids and URLs (these
    have host '') are rows like others."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    found = rows.join(shared_blocks(rows.select("key", "url", "html")), "key", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [main_text(h, set(g or ())) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            counts = [pa.array([f(x) for x in texts], pa.int64()) for f in (lambda x: len(x[0]), *(lambda x, k=k: x[k] for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in texts], pa.string()), *counts], names=[c.split()[0] for c in TEXT.split(", ")])

    return found.select("page_id", "url", "html", "gone").mapInArrow(each, TEXT)
