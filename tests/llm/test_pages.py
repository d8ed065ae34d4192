"""Page differences against a plain version on the pages of the test tables, and on hostile pages."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from attrium.llm import pagediff

PAGES = "/root/testdata/sf0.01/pages.parquet"


def table(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n


def aligned(a, b):
    """Lines of one longest common subsequence, by the whole table."""
    n, i, j, out = table(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif n[i - 1][j] >= n[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_lcs(monkeypatch):
    rng = random.Random(7)
    for room in (pagediff.FULL, 8):
        monkeypatch.setattr(pagediff, "FULL", room)
        for _ in range(200):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
            kept = pagediff.lcs(a, b)
            rest = iter(b)
            assert all(x in rest for x, k in zip(a, kept, strict=True) if k) and sum(kept) == table(a, b)[-1][-1]


def untold(html):
    """The page without markup that tells what its parts are."""
    html = re.sub(r"<(/?)(nav|article|footer|header|main|aside|ul|li|h1)\b", r"<\1div", html)
    return re.sub(r" (class|id|role)=\"[^\"]*\"", "", html)


def brute(rows):
    """Text of each page: its blocks but those shared with the nearest of two pages on either side that is no copy."""
    parts = []
    for i, url, html in rows:
        rest = url.partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        parts.append((host.lower(), re.match("[^?#]*", rest[len(host) :])[0], i, pagediff.blocks(html)))
    out, changed = {}, 0
    by_host = {}
    for p in parts:
        by_host.setdefault(p[0], []).append(p)
    for pages in by_host.values():
        pages.sort(key=lambda p: p[1])
        for k, (_, path, i, own) in enumerate(pages):
            shared_path = lambda p: next((n for n, (x, y) in enumerate(zip(path, p[1])) if x != y), min(len(path), len(p[1])))  # noqa: B023, E731
            sides = [pages[j] for d in (1, 2) for j in (k - d, k + d) if 0 <= j < len(pages)]
            gone = []
            for p in sorted(sides, key=lambda p: -shared_path(p)):
                both = aligned([x for x, _ in own], [x for x, _ in p[3]])
                left = list(both)
                size = sum(len(x) for x, kind in own if x in left and not left.remove(x) and kind != pagediff.CHROME)
                if 2 * size <= sum(len(x) for x, kind in own if kind != pagediff.CHROME):
                    gone = both
                    break
            keep = lambda x, kind: kind == pagediff.BODY or (kind == pagediff.OPEN and x not in gone)  # noqa: B023, E731
            out[i] = " ".join(x for x, kind in own if keep(x, kind))
            changed += out[i] != " ".join(x for x, kind in own if kind != pagediff.CHROME)
    return out, changed


@pytest.mark.parametrize("told", [True, False])
def test_pages_against_plain_version(spark, told):
    df = spark.read.parquet(PAGES).dropDuplicates(["url"])
    rows = [(r["page_id"], r["url"], r["html"] if told else untold(r["html"])) for r in df.collect()]
    want, changed = brute(rows)
    assert (changed == 0) == told
    got = pagediff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).toPandas()
    assert dict(zip(got["page_id"], got["text"], strict=True)) == want
    if told:
        article = {i: re.search(r"(?s)<article>.*</article>", h)[0] for i, _, h in rows}
        assert want == {i: " ".join(x for x, _ in pagediff.blocks(h)) for i, h in article.items()}


def test_runs_meet_at_their_ends(spark, monkeypatch):
    """Cutting the order into runs changes nothing."""
    rows = [(i, f"http://h{i % 3}.x/a/{i:04d}", f"<div>menu {i // 9}</div><div>only page number {i} has this</div><div>foot</div>") for i in range(70)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(tuple(r) for r in pagediff.extract_pages(df).collect())
    monkeypatch.setattr(pagediff, "GROUP", 4)
    assert sorted(tuple(r) for r in pagediff.extract_pages(df.repartition(5)).collect()) == whole
    assert [r[2] for r in whole][:3] == [f"only page number {i} has this" for i in range(3)]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<!x" * 300_000, "<a \"'>x" * 140_000, "<div>" * 90_000 + "</b>" * 90_000, "<b>" * 90_000 + "<hr>" * 90_000, "<script>" + "</script " * 110_000, "<p>x" * 200_000])
def test_hostile_pages_take_seconds(page):
    began = time.time()
    pagediff.blocks(page)
    assert time.time() - began < 20


def test_long_pages_align_in_seconds():
    rng, began = random.Random(3), time.time()
    a, b = ([rng.randrange(2) for _ in range(60_000)] for _ in range(2))
    assert 0.75 * 60_000 < sum(pagediff.lcs(a, b)) < 60_000
    assert time.time() - began < 30


def test_page_edges(spark):
    rows = [(1, None, "<p>a"), (None, "http://h/x", None), (2, "http://h/x", ""), (3, "http://h/y", "<p>b"), (3, "http://h/y", "<p>b"), (3, "http://h/y", "<p>c"), (4, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "text", "gone", "host", "path", "at", "n_chars")})
    got = sorted((r["page_id"] or 0, r["text"]) for r in pagediff.extract_pages(df).collect())
    assert got == [(0, ""), (1, "a"), (2, ""), (3, "b"), (3, "b"), (3, "c"), (4, "x")]
    assert pagediff.extract_pages(df.limit(0)).count() == 0
