"""Second versions of what SQL can't say, or can in part."""

import math

import numpy as np
import zstandard
from compare import connection
from pyspark.sql import functions as F

from attrium.llm import compression, queries, store, urlfilter

SF = "/root/testdata/sf0.001"


def ratio(raw):
    return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(raw)) / len(raw)


def limits(size, bands):
    """Low and high limit of a text of that size: between two bands on the straight line over the logarithm of sizes."""
    after = next((i for i, b in enumerate(bands) if b.size >= size), len(bands))
    if after in (0, len(bands)):
        b = bands[0 if after == 0 else -1]
        return b.low, b.high
    a, b = bands[after - 1], bands[after]
    t = (math.log2(size) - math.log2(a.size)) / (math.log2(b.size) - math.log2(a.size))
    return a.low + t * (b.low - a.low), a.high + t * (b.high - a.high)


def verdict(raw, bands):
    if not raw:
        return ""
    pieces = [raw[i : i + compression.CHUNK] for i in range(0, len(raw), compression.CHUNK)]
    if len(pieces) > 1 and 2 * len(pieces[-1]) < compression.CHUNK:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    low, high = limits(len(raw), bands)
    if not low <= ratio(raw) <= high:
        return "repetitive" if ratio(raw) < low else "incompressible"
    if len(pieces) == 1:
        return ""
    odd = sum(not (lambda x: x[0] <= ratio(p) <= x[1])(limits(len(p), bands)) for p in pieces)
    return "chunks" if odd / len(pieces) > compression.BAD_CHUNKS else ""


def test_bands_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = np.random.default_rng(1)
    more = [("again and again " * 4000,), (" ".join(noise.bytes(9).hex() for _ in range(9000)),), ("ab cd ef gh ij kl mn op qr st uv",), ("a b " * 30,)]
    rows = docs.select("text").unionByName(spark.createDataFrame(more, "text string")).select(F.monotonically_increasing_id().alias("doc_id"), "text")
    bands = compression.calibrate(docs, spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"))
    out = {r["doc_id"]: r for r in compression.quality_rules(rows, bands=bands).collect()}
    reasons = []
    for r in rows.collect():
        why = verdict((r["text"] or "").encode(), bands)
        got = out[r["doc_id"]]
        assert got["reason"] == ("base" if got["base_failed"] else why) and got["kept"] == (not got["base_failed"] and not why)
        reasons.append(why)
    assert {"", "repetitive", "incompressible"} <= set(reasons)


def test_bands_from_all_texts(spark):
    """Of 30,000 clean texts each counts: the bands are those that numpy gives for all of them."""
    rng = np.random.default_rng(5)
    words = [rng.bytes(4).hex()[: rng.integers(2, 8)] for _ in range(3_000)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(12, 60, 30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    raw = [t.encode() for t in texts if not compression.base_failed(compression.base_counts(t))]
    want = compression.bands_of(np.array([len(r) for r in raw], float), np.array([compression.ratio(r) for r in raw]))
    got = compression.calibrate(docs, docs.select("doc_id"))
    assert len(got) == len(want) > 3
    for a, b in zip(got, want, strict=True):
        assert abs(a.size / b.size - 1) < 1e-6 and abs(a.low - b.low) < 1e-5 and abs(a.high - b.high) < 1e-5


def test_base_counts_against_sql(spark):
    con = connection(SF)
    want = con.execute(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t)),
    d AS (SELECT doc_id, count_if(k > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS n FROM l GROUP BY 1),
    g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
    m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM m, range(0, 5) x(o) GROUP BY 1)
    SELECT doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), len(regexp_extract_all(text, '[#*$%&|<>]')), d.n, coalesce(r.n, 0) FROM t JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)""").fetchall()
    got = compression.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(tuple(map(int, r)) for r in want) == sorted(map(tuple, got))


def test_hosts_paths_and_rules_against_sql(spark):
    rules = [(r.verdict, r.rule) for r in urlfilter.RULES]
    con = connection(SF)
    want = con.execute(f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
    r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, concat('/', substr(rule, length(split_part(rule, '/', 1)) + 2)) AS start FROM (VALUES {", ".join(map(str, rules))}) t(verdict, rule)),
    f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = h OR suffix(host, concat('.', h))) AND prefix(path, start) GROUP BY 1)
    SELECT page_id, coalesce(host, ''), coalesce(path, ''), rule, verdict FROM p LEFT JOIN f USING (page_id)""").fetchall()
    got = {r["page_id"]: r for r in queries.op8_url_filter(spark, SF).collect()}
    assert len(got) == len(want) and sum(r[3] is not None for r in want) > 10
    for page_id, host, path, rule, verdict_ in want:
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == verdict_)


def test_long_and_repeated_urls(spark):
    rows = [(1, "http://a.com/" + "x/" * 50_000 + "?q=" + "y" * 100_000)] * 2 + [(2, "http://b.org/?" + "&a=1" * 30_000), (2, None)]
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == 4 and {r["verdict"] for r in out} <= {"allow", "block"} and sum(r["rule"] == "com/" for r in out) == 2


def test_pipeline_leaves_only_what_is_still_read(spark):
    import corpus_pipeline

    def stored():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store.shared_dir(spark)}/{store.RUN}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {x.getPath().getName().rsplit("-", 1)[0] for x in files.listStatus(path)} if files.exists(path) else set()

    store.discard(spark)
    out = corpus_pipeline.run(spark, SF)
    assert stored() == {"mixture"} and out.count() > 50
