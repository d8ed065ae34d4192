"""Boundary chains: round trips, magic in payloads, members, splits, torn files."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attrium.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
BIG = "payload " * 30
ROWS = [(1, "http://a", FAKE * 3), (2, "u\r\nX: y", BIG), (3, None, BIG), (4, "d", None), (5, "e", ""), (6, "f", "WARC/1.0\r\n"), (7, "g", "é" * 100), (8, "h", BIG), (None, "i", BIG), (2, "j", BIG), (2**60 + 1, "k", "\nWARC/1."), (11, "l", "x\r\n\r\n\nWARC/1.1\r\n\r\n\nWARC/1.")]


def wanted(rows):
    return sorted((i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == BIG and i != 2 else "response", 2 if h == BIG and i != 2 else 0) for i, _, h in rows)


def got(df):
    return sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in df.collect())


@pytest.mark.parametrize("sent", [warc.SENT, 0])
def test_round_trip(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit(1) for c in ("digest", "first", "bytes", "salt", "file")})
    assert got(warc.archived(df, str(tmp_path / "w"))) == wanted(ROWS)
    assert warc.archived(df.limit(0), str(tmp_path / "none")).count() == 0


def record(i, body):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)


def bodies(n):
    """Payloads of any bytes; some hold whole records, their beginnings, or parts of the magic at their ends."""
    rng = random.Random(n)
    odd = [b"\r\n\r\n", b"\n", b"\nWARC/1", b"\nWARC/1.0\r\n", b"\r\n\r\nWARC/1.0\r\n", record(5, b"HTTP/1.1 200 OK\r\n\r\nnot me"), b"\nWARC/1.\nWARC/1.", b"\nWARC/1.0\r\nContent-Length: 40\r\n\r\n"]
    return [b"HTTP/1.1 200 OK\r\n\r\n" + b"".join(rng.choice([*odd, rng.randbytes(rng.randrange(60))]) for _ in range(rng.randrange(7))) for _ in range(n)]


@pytest.mark.parametrize(("split", "run", "cell"), [(128 << 20, 1 << 16, 1 << 26), (4096, 16, 512), (700, 4, 64)])
def test_files_cut_into_splits(spark, tmp_path, monkeypatch, split, run, cell):
    monkeypatch.setattr(warc, "RUN", run)
    for name, n in (("one", 1), ("some", 40), ("many", 600)):
        (tmp_path / f"{name}.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies(n))))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            spark.conf.set(c, split)
        out = [(r["page_id"], r["payload_digest"]) for r in warc.read_archives(spark, str(tmp_path), cell).collect()]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sorted(out) == sorted((i, hashlib.sha256(b[19:]).hexdigest()) for n in (1, 40, 600) for i, b in enumerate(bodies(n)))


def test_members_and_torn_files(spark, tmp_path):
    members = [gzip.compress(record(i, b)) for i, b in enumerate(bodies(300))]
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "many.warc.gz").write_bytes(b"".join(members))
    out = warc.read_archives(spark, str(tmp_path / "good")).collect()
    assert sorted((r["page_id"], r["payload_digest"]) for r in out) == [(i, hashlib.sha256(b[19:]).hexdigest()) for i, b in enumerate(bodies(300))]
    plain = b"".join(record(i, b"x" * 50) for i in range(9))
    for k, (name, torn) in enumerate([("a.warc.gz", b"".join(members)[:-9]), ("b.warc", plain[:-60]), ("c.warc", plain[:-2]), ("d.warc", b"junk" + plain), ("e.warc", plain.replace(b"Length: 50", b"Length: 51", 1))]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / name).write_bytes(torn)
        with pytest.raises(Exception, match="breaks off|EOF|[Uu]nexpected end|no end"):
            warc.read_archives(spark, str(tmp_path / str(k))).collect()
