"""The ten operators against plain Python, and their edge cases."""

import itertools
import random
import time

import numpy as np
import pytest
import xxhash
from compare import compare, connection
from pyspark.sql import functions as F

from attrium.llm import compression, knn, langid, line_dedup, minhash, mixing, pagediff, pieces, queries, simhash, urlfilter
from attrium.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_lines long"
EDGES = [(1, None, "en", None, 7), (2, "", None, "a", None), (None, "no id here at all, none", "en", "a", 1), (3, "x " * 50_000, "en", "a", 1), (3, "x " * 50_000, "en", "a", 1), (4, "same old text of some words", "en", "a", 1), (5, "same old text of some words", "de", "b", 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}


def test_cuckoo_filter_takes_in_and_out():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    f = line_dedup.CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def brute_lines(docs):
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return sorted((i or -1, "\n".join(x for x in (t or "").split("\n") if i is None or gone.get(key(x), i) == i)) for i, t in docs)


LINES = ["A line that many documents share ÉÀ", "  a line that MANY documents share ÉÀ\t", "short", "another line that comes up in a few", "ééééééééééééééééééé", "ééééééééééééééééééée"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lines_and_reversal(spark, limit):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice([*LINES, f"only here, line number {rng.random()}"]) for _ in range(6))) for i in range(60)] + [(7, LINES[0]), (None, LINES[0]), (99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, broadcast_bytes=limit, keys_per_shard=2).insert(df)
    out = lambda index, df: sorted((r[0] or -1, r[1]) for r in index.clean(df).select("doc_id", "_lines.text").collect())
    before = out(index, df)
    assert before == brute_lines(docs)
    more = spark.createDataFrame([(1000 + i, "only in the second batch, twice\n" + LINES[3]) for i in range(4)], "doc_id long, text string")
    larger = index.insert(more)
    assert out(larger, df) == [x for x in brute_lines(docs + [tuple(r) for r in more.collect()]) if x[0] < 1000]
    assert out(larger.insert(more), df) == out(larger, df)
    assert out(larger.delete(more), df) == before
    counts = lambda index: sorted(tuple(r) for r in index.refs.collect())
    assert counts(larger.delete(more)) == counts(index) and counts(larger.insert(more)) == counts(larger)


def test_lines_edges(spark, edges):
    out = line_dedup.dedup_lines(edges)
    assert out.count() == len(EDGES) and out.columns[1:] == edges.columns
    assert line_dedup.dedup_lines(edges.limit(0)).count() == 0


def test_base_counts():
    def brute(t):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t or "") if w]
        wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        rep = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(5)}
        lines = (t or "").split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(rep)

    rng = random.Random(3)
    texts = [None, "", " \n\n", "a\x85b c d"] + ["".join(rng.choice(["a ", "b ", "é", "\n", "#", "c d e "]) for _ in range(60)) for _ in range(60)]
    for t in texts:
        assert compression.base_counts(t) == brute(t), t


def test_bands_reject_repeats_and_noise():
    rng = random.Random(4)
    clean = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    bands = compression.bands_of(*(np.array(x, float) for x in zip(*((len(t), compression.ratio(t)) for t in (clean[i : i + n].encode() for n in (200, 400, 800, 1600, 3200) for i in range(0, 1500, 25))), strict=True)))
    assert len(bands) == 5 and compression.verdict(clean.encode(), bands)[2] == ""
    for n in (300, 700, 6000):
        assert compression.verdict(noise(n).encode(), bands)[2] == "incompressible"
        assert compression.verdict((b"abc def ghi jkl mno " * n)[:n], bands)[2] == "repetitive"
    assert compression.verdict((clean[:2600] + noise(1300)).encode(), (compression.Band(512, 0.0, 0.8), compression.Band(1024, 0.0, 0.7), compression.Band(4096, 0.0, 0.9)))[2] == "chunks"
    assert [len(c) for c in compression.chunks(b"x" * 2500)] == [1024, 1476] and [len(c) for c in compression.chunks(b"x" * 2600)] == [1024, 1024, 552]
    assert compression.bands_of(np.array([]), np.array([])) == ()


def test_bands_on_labels_not_used_for_them(spark):
    """Recall of low quality and clean texts kept, on the half of the labels that calibration doesn't see."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    bands = compression.calibrate(docs, labels.filter("quality = 1 and doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").join(compression.quality_rules(docs, bands=bands), "doc_id").filter("not base_failed").toPandas()
    low, clean = held[held["quality"] == 0], held[held["quality"] == 1]
    assert (~low["kept"]).mean() > 0.7 and clean["kept"].mean() > 0.99
    assert set(held["reason"]) >= {"", "repetitive"}


def test_quality_edges(spark, edges):
    out = compression.quality_rules(edges).collect()
    assert len(out) == len(EDGES) and all(r["base_failed"] for r in out if r["doc_id"] in (1, 2, 3))
    assert compression.quality_rules(edges.limit(0)).count() == 0
    assert compression.calibrate(edges, edges) == compression.BANDS == compression.calibrate(edges.limit(0), edges.limit(0))


def brute_simhash(t):
    words = (t or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_match_spark_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)
    for t in (None, "", "One", "One two", "One two THREE four É", "a b c " * 40):
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_simhash(t)


@pytest.mark.parametrize("hot", [256, 2])
def test_near_links_find_all_within_two_bits(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(12)} | {0, 3, 2**63}
    fps = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(near, "u long, v long")).collect()}
    assert got == want


def test_simhash_edges(spark, edges):
    out = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(edges).collect()}
    assert {(1, 1), (2, 1), (4, 4), (5, 4), (3, 3), (None, None)} == out
    assert simhash.simhash_components(edges.limit(0)).count() == 0
    clash = edges.withColumns({c: F.lit(1) for c in ("fp", "component_id", "n", "_text", "_appended_from", "least", "key")})
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(clash).collect()} == out


@pytest.mark.parametrize("hot", [16, 2])
def test_stage_finds_all_similar_texts(spark, monkeypatch, hot):
    import corpus_pipeline

    monkeypatch.setattr(minhash, "HOT", hot)
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 300))]
        for k in range(9):
            words = list(base)
            for _ in range(k * len(base) // 150 + (k > 6)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, texts[0].upper()), (None, "alone"), (1, texts[20])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert any(((simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])) & (2**64 - 1)).bit_count() > 2 for a, b in near)
    part = list(range(len(rows)))
    for a, b in near:
        part = [part[a] if x == part[b] else x for x in part]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if part[i] == c and rows[i][0] is not None), default=None) for c in set(part)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda pairs: sorted(pairs, key=repr)
    assert order(tuple(r) for r in minhash.near_duplicates(docs).collect()) == order((i, ids[part[k]]) for k, (i, _) in enumerate(rows))
    # of each component the row with the smallest id stays, the first of those that repeat it; without id comes last
    first = [min((i for i in range(len(rows)) if part[i] == c), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for c in set(part)]
    assert order(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == order(rows[i] for i in first)


def test_stage_chooses_rows_not_ids(spark):
    import corpus_pipeline

    a, z = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    for rows, want in (
        ([(0, a), (1, a), (1, z)], [(0, a), (1, z)]),
        ([(0, a), (None, a), (None, z)], [(0, a), (None, z)]),
        ([(None, a), (None, a), (None, z), (3, z)], [(None, a), (3, z)]),
        ([(5, a), (5, a), (2, "")], [(5, a), (2, "")]),
        ([], []),
    ):
        docs = spark.createDataFrame([(*r, {"k": 1}, 7, "x") for r in rows], "doc_id long, text string, doc map<string,int>, row int, a string")
        found = corpus_pipeline.near_duplicates(spark, docs, "")
        assert found.columns == docs.columns and sorted((tuple(r)[:2] for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_set_join_finds_all_similar_sets(spark):
    """Near copies of one text, which share most of their shingles, and texts of some words only."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        texts.append(" ".join(words[: rng.choice([150, 150, 140, 125])]))
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    sets = [minhash.shingles(t) for t in texts]
    root = [rng.randrange(40) for _ in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if root[i] != root[j] and minhash.similar(sets[i], sets[j])}
    found = [tuple(r) for r in minhash._set_pairs(spark.createDataFrame([(i, root[i], t) for i, t in enumerate(texts)], "node long, root long, text string")).collect()]
    assert want <= set(found) and len(found) == len(set(found)) < 2 * len(want) and len(want) > 300


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() >= 0.97
    assert out["score"].between(0, 1).all()


def test_language_mixture_and_edges(spark, edges):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    en, fr = (next(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter(f"lang = '{x}' and length(text) > 1500").collect()) for x in ("en", "fr"))
    row = langid.predict(spark.createDataFrame([(en[:1000] + " " + fr[:1000],)], "text string"), model).first()
    assert set(row["languages"]) == {"en", "fr"} and 0.3 < min(row["proportions"])
    out = langid.predict(edges, model)
    assert {r["lang_pred"] for r in out.filter("text is null or text = ''").collect()} == {"und"}
    assert langid.identify(edges.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0
    assert langid.identify(edges.limit(0)).count() == 0


def test_every_language_is_weighed():
    """Ten languages alike and one of its own: the tenth of a text in that one counts, whatever stands before it."""
    rng = np.random.default_rng(8)
    base = np.concatenate([rng.random(300), np.full(300, 1e-7)])
    p = np.stack([base * np.concatenate([rng.uniform(0.7, 1.4, 300), np.ones(300)]) for _ in range(10)] + [base[::-1]])
    p /= p.sum(axis=1, keepdims=True)
    counts = np.round(5000 * (0.9 * p[3] + 0.1 * p[10]))
    at = np.nonzero(counts)[0]
    every, chosen, w = langid.mixture(counts[at], at, p, np.log(p))
    assert chosen.tolist() == [3, 10] and w[1] == pytest.approx(0.1, abs=0.02) and every[10] == pytest.approx(0.1, abs=0.02)
    # one that fails the penalty doesn't end the choice: here the second in weight is near to the first
    p = np.array([[0.5, 0.5, 1e-9], [0.62, 0.38, 1e-9], [1e-9, 1e-9, 1.0]])
    p /= p.sum(axis=1, keepdims=True)
    every, chosen, _ = langid.mixture(np.array([5300.0, 4200.0, 500.0]), np.arange(3), p, np.log(p))
    assert every[1] > every[2] and chosen.tolist() == [0, 2]


def test_time_with_many_similar_languages():
    """A hundred languages that hardly differ, and a text of a million trigrams."""
    rng = np.random.default_rng(2)
    base = rng.dirichlet(np.full(langid.DIM, 0.1)) + 1e-7
    p = np.stack([base * rng.uniform(0.95, 1.05, langid.DIM) for _ in range(100)])
    p /= p.sum(axis=1, keepdims=True)
    counts = rng.multinomial(1_000_000, 0.6 * p[3] + 0.4 * p[70]).astype(float)
    at = np.flatnonzero(counts)
    began = time.process_time()
    every, chosen, _ = langid.mixture(counts[at], at, p, np.log(p))
    assert time.process_time() - began < 60 and len(chosen) == 1 and every.sum() == pytest.approx(1)
    # no mixture is much better
    mixed = every @ p[:, at]
    assert (p[:, at] @ (counts[at] / mixed)).max() - counts.sum() <= 1


def brute_top_k(rows, dim, every, k=5):
    ints = {i: [int(np.floor(256 * x)) for x in v] + [0] * (dim - len(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    held = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    want = []
    for q in (i for i in ints if i % every == 0):
        best = sorted((-held(sum(a * b for a, b in zip(ints[q], v, strict=True))), i) for i, v in ints.items() if i != q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


def test_sets_of_languages_against_all_sets():
    """Random mixtures of four languages: the chosen set is the best of all fifteen."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        p = rng.dirichlet(np.full(400, 0.3), 4) * 0.98 + 0.02 / 400
        w = rng.dirichlet(np.full(4, 0.4))
        counts = rng.multinomial(int(rng.integers(20, 3000)), w @ p).astype(float)
        at = np.flatnonzero(counts)
        every, chosen, found = langid.mixture(counts[at], at, p, np.log(p))
        n = counts.sum()
        least = langid.PENALTY * n + 0.5 * np.log(n)
        value = lambda s: (langid._em(p[list(s)][:, at], counts[at])[1]) - least * len(s)  # noqa: B023, E731
        best = max((s for k in range(1, 5) for s in itertools.combinations(range(4), k)), key=value)
        assert value(tuple(sorted(chosen.tolist()))) >= value(best) - langid.NEAR
        assert every.sum() == pytest.approx(1) and found.sum() == pytest.approx(1) and (np.diff(found) <= 0).all()


@pytest.mark.parametrize(("sent", "seed"), [(knn.SENT, knn.SEED), (0, 16)])
def test_voronoi_is_exact(spark, monkeypatch, sent, seed):
    monkeypatch.setattr(knn, "SENT", sent)
    monkeypatch.setattr(knn, "SEED", seed)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)] + [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [0.0] * 8), (504, [1.0, 2.0]), (None, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("g", "x", "b", "h", "ring", "q")})
    got = sorted(tuple(r) for r in knn.voronoi_top_k(df, F.col("vec_id") % 7 == 0, 5, pivots=5, query_block=16, data_block=64).collect())
    assert got == brute_top_k(rows, 8, 7)
    assert knn.voronoi_top_k(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0
    assert knn.voronoi_top_k(df, F.lit(False)).count() == 0
    assert len(knn.voronoi_top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()) == 2


def test_wide_components_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 9)).tolist()) for i in range(80)] + [(80, [1e300, -1e300, 1.7e308, 0.0]), (81, [-1.7e308] * 4), (84, [2.0**40 + 1, 1.0, -1.0, 3.0])]
    got = sorted(tuple(r) for r in knn.voronoi_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, query_block=8, data_block=32).collect())
    want = brute_top_k([(i, v) for i, v in rows if i < 80 or i == 84], 4, 4)
    assert [r for r in got if r[0] not in (80, 81)] and {r[0] for r in got} == {r[0] for r in want} | {80}
    exact = {(i, j): max(-(2**63) + 1, min(2**63 - 1, sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w, strict=True)))) for i, v in rows for j, w in rows if max(map(abs, v + w)) < 1e290}
    assert all(exact[q, s] == score for q, _, s, score in got if (q, s) in exact)


def test_only_needed_rows_are_sent(spark):
    """Where vectors lie in clusters, most rows go to one block of queries only."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] / np.linalg.norm(centres[i % 12]) + 0.02 * rng.normal(size=32)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = knn.plan(df, F.col("vec_id") % 5 == 0, pivots=24, query_block=100)
    assert made.blocks >= 10 and made.sent.count() < 0.25 * made.blocks * len(rows)
    assert sorted(tuple(r) for r in knn.voronoi_top_k(df, F.col("vec_id") % 50 == 0, pivots=24, query_block=20).collect()) == brute_top_k(rows, 32, 50)


def test_raking_meets_marginals(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs, mixing.form(F.col("text"))).toPandas()
    out["w"] = out["tokens"] * out["ratio"]
    for d, power in mixing.POWERS.items():
        had, got = out.groupby(d)["tokens"].sum(), out.groupby(d)["w"].sum()
        want = had**power / (had**power).sum() * had.sum()
        assert np.allclose(got, want, rtol=1e-9)
        # drawn documents miss their targets by chance alone; weights of clipped ones aren't lost
        drawn = out.groupby(d).apply(lambda g: (g["tokens"] * g["copies"]).sum(), include_groups=False) / (0.8 * out["tokens"].sum())
        assert np.abs(drawn - want / out["tokens"].sum()).max() < 0.06
    assert abs(out.loc[out.kept, "tokens"].sum() / out["tokens"].sum() - 0.75) < 0.2
    assert (out["copies"] > 1).any() and ((out["copies"] > 0) >= out["kept"]).all()
    again = mixing.resample(docs, mixing.form(F.col("text")))
    assert again.columns == docs.columns and sorted(r[0] for r in again.select("doc_id").collect()) == sorted(out["doc_id"].repeat(out["copies"]))
    assert mixing.resample(edges, F.lit(None).cast("string")).columns == edges.columns and mixing.resample(edges.limit(0), F.lit("t")).count() == 0
    assert mixing.mix(edges, F.lit(None).cast("string")).count() == len(EDGES)
    assert mixing.mix(edges.limit(0), F.lit("t")).count() == 0


@pytest.mark.parametrize("most", [mixing.CELLS, 0])
def test_raking_goes_on_until_targets_are_met(spark, monkeypatch, most):
    """Cells that are hard to balance are, and targets out of reach are told."""
    monkeypatch.setattr(mixing, "CELLS", most)

    def raked(tokens, shares):
        cells = spark.createDataFrame([("ab"[i], "xy"[j], tokens[i][j]) for i in range(2) for j in range(2)], "source string, lang string, tokens long")
        total = sum(map(sum, tokens))
        wanted = {d: spark.createDataFrame([(v, s * total) for v, s in zip(names, of, strict=True)], f"{d} string, target double") for d, names, of in (("source", "ab", shares[0]), ("lang", "xy", shares[1]))}
        out = mixing.rake(cells, wanted).toPandas()
        out["w"] = out["tokens"] * out["ratio"] / total
        return out.groupby("source")["w"].sum().tolist(), out.groupby("lang")["w"].sum().tolist(), set(out["settled"])

    hard = [[100_000, 100], [100, 100_000]] if most else [[300, 100], [100, 300]]
    by_source, by_lang, settled = raked(hard, ([0.8, 0.2], [0.2, 0.8]))
    assert by_source == pytest.approx([0.8, 0.2], rel=1e-7) and by_lang == pytest.approx([0.2, 0.8], rel=1e-7) and settled == {True}
    if most:
        by_source, by_lang, settled = raked([[100, 0], [0, 100]], ([0.8, 0.2], [0.2, 0.8]))
        assert by_lang == pytest.approx([0.2, 0.8]) and settled == {False}


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    names = ("_lines", "_lid_score", "_lid_lang_pred", "_cell", "cell", "doc", "row", "copies", "ratio", "_key")
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    docs = rows.withColumns({n: F.create_map(F.lit(n), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(next(iter(r[n].items())) for n in names) for r in out.collect()} <= {tuple((n, i) for n in names) for i in range(40)}


PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><div>Site of all things</div><header>Top</header><div class='ad big'>Buy</div>{}<section id=comments><p>me too</p></section><div>Imprint and terms</div><footer>foot</footer></body>"


def test_pages(spark):
    body = ["<p>First text of %d &amp; more<br>next   line %d</p><ul><li>one %d</ul>" % (i, i, i) for i in range(4)]
    rows = [(i, f"http://h.example/a/{i}", PAGE.format(b)) for i, b in enumerate(body)]
    rows += [(9, "http://h.example/a/9", PAGE.format("<article><h1>H</h1><p>x <b>y</b>z<aside>no</aside><form><input>f</form></article>")), (10, None, None), (11, "x", ""), (12, "http://lone/", "<p>a<p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r["text"] for r in pagediff.extract_pages(df).collect()}
    for i in range(4):
        assert out[i] == f"First text of {i} & more next line {i} one {i}"
    assert out[9] == "H x yz" and out[10] == "" and out[11] == "" and out[12] == "a b"
    assert pagediff.extract_pages(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/1"), (2, "https://WWW.example.com/en/1?x"), (3, "http://b.net/es/9"), (4, "http://b.net/de/9"), (5, None), (6, "no scheme"), (7, "http://x.com"), (8, "http://other.com/z#f"), (None, "http://b.net/fr/")]
    clash = {c: F.lit(1) for c in ("host", "label", "fold", "suffix", "length", "features", "rule")}
    out = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumns(clash)).collect()}
    assert [(out[i]["rule"], out[i]["verdict"]) for i in (1, 2, 3, 8, None)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("com/", "allow"), ("net/fr/", "block")]
    assert out[4]["rule"] is None and out[7]["rule"] is None and (out[5]["host"], out[6]["path"]) == ("", "")
    assert (out[2]["host"], out[2]["path"]) == ("www.example.com", "/en/1")
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_trees_judge_hosts_not_learned_from(spark):
    """Labels of half of the hosts; the other half is judged by how its URLs look."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urlfilter.with_parts(pages, F.col("url")).withColumn("truth", urlfilter.weak_label(F.lit(None).cast("string")))
    seen = F.pmod(F.xxhash64("host", F.lit(2)), F.lit(2)) == 0
    judged = urlfilter.judge_urls(rows.withColumn("known", F.when(seen, F.col("truth"))), rules=(urlfilter.Rule("block", "none/"),), label_col="known")
    held = judged.join(rows.filter(~seen).select("page_id", "truth"), "page_id").toPandas()
    blocked = held["verdict"] == "block"
    assert held["truth"].sum() > 20 and blocked[held["truth"] == 1].mean() > 0.9 and blocked[held["truth"] == 0].mean() < 0.02


def test_suffix_statistics_leave_out_the_own_fold(spark):
    rows = [("com", 0, 1.0), ("com", 0, 1.0), ("com", 1, 0.0), ("net", 2, 1.0)]
    out = {(r["suffix"], r["fold"]): round(r["suffix_rate"], 6) for r in urlfilter.suffix_statistics(spark.createDataFrame(rows, "suffix string, fold int, label double")).collect()}
    assert out == {("com", 0): round(1 / 3, 6), ("com", 1): 0.75, ("com", None): 0.6, ("net", 2): 0.5, ("net", None): round(2 / 3, 6)}


def test_pieces(spark, edges):
    v = pieces.Vocabulary.load(queries.model_path())
    lattice = pieces.Lattice(v)

    def brute(s):
        out = []

        def go(i, score):
            if i == len(s):
                out.append(score)
                return
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in v.scores:
                    go(j, score + v.scores[s[i:j]])
            if s[i] not in v.scores:
                go(i + 1, score + v.lowest - pieces.UNKNOWN)

        go(0, 0.0)
        return sorted(out, reverse=True)

    for t in ("ab c", "the in", "a  b", "x\ny", "ça va", " ", "♞a"):
        want = brute("▁" + t.replace(" ", "▁"))[:4]
        got = lattice.n_best(t, 4)
        assert [s for s, _ in got] == want and all(lattice.decode(ids) == t for _, ids in got)
    texts = ["", "▁ a▁▁b", "\0▁x", "tab\tand\r\n  spaces  ", "汉字 😀 é", "x" * 3000, "汉字x" * 99, None]
    for t, (units, found) in zip(texts, lattice.encode(texts), strict=True):
        assert lattice.decode([i for ids, _, _ in found for i in memoryview(ids).cast("i")]) == (t or "")
        for u, (_, score, gap) in zip(units, found, strict=True):
            if u == pieces.OWN:
                continue
            ways = [s for s, _ in lattice.a_star(u, 2)]
            assert score == pytest.approx(ways[0]) and gap == pytest.approx(ways[0] - ways[1] if len(ways) > 1 else float("inf"))
    assert [len(g) for g in pieces.groups(["a" * pieces.TOGETHER, None, "b"] * 2)] == [2, 1, 2, 1]
    out = pieces.encode_pieces(edges, queries.model_path()).collect()
    assert len(out) == len(EDGES) and all(r["round_trip"] for r in out)
    texts = [(i, t) for i, t in enumerate(["the internationalisation of it all", "ab c", "x", "", None, "▁ a▁▁b 汉字", "aaa bbb aaa bbb"])]
    found = pieces.segmentations(pieces.encode_pieces(spark.createDataFrame(texts, "doc_id long, text string"), queries.model_path(), 6)).orderBy("doc_id", "rank").collect()
    want = [(i, k + 1, ids) for i, t in texts for k, (_, ids) in enumerate(lattice.n_best(t, 6))]
    assert [(r["doc_id"], r["rank"], r["ids"]) for r in found] == want and len(want) > 20
    assert [r["score"] for r in found] == pytest.approx([s for _, t in texts for s, _ in lattice.n_best(t, 6)])
    back = pieces.decode_pieces(pieces.encode_pieces(edges, queries.model_path()), queries.model_path()).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, *_ in EDGES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert compare(spark, connection(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_pipeline_edges(spark):
    """Nulls in any column, empty and long texts, repeated rows and no rows at all."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 30").collect()
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [tuple(r) for r in rows]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "only one without an id, but quite a text", "en", None, 5), (1002, rows[0][1] * 60, None, "s", None), rows[3], rows[3]]
    for rows_in in (rows, []):
        docs = spark.createDataFrame(rows_in, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "near_duplicates":
                ids = [r["doc_id"] for r in out.collect()]
                assert len(ids) == len(set(ids))
            if name != "pieces":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), schema)
            else:
                assert out.count() == docs.count() and (docs.count() > 5) == bool(rows_in)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
    assert 0.4 * n < docs.count() < n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert out["round_trip"].all() and len(out) == docs.count()
