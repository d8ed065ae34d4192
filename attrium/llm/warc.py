"""WARC archives: writing, and reading by boundary chains.

A record's payload may hold the very bytes that begin a record. So the tasks that read the splits of a file
emit every place where a record may begin, with the place where it would end (its successor); jumping along
these pointers from the start of the file reaches the true records and none inside a payload. Within a run of
places the jumps are made on arrays; what is left of them, one pointer out of each run, is jumped twice as far
in each round by joins, across the splits of the file. Payloads are hashed where they are read: only those
that a false beginning cuts in pieces are read again and put together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .store import new_path, slices, stored

END = "\r\n\r\n"
MAGIC = b"WARC/1."
CUT = b"\n" + MAGIC  # files are read in the pieces between these; no beginning of it is also its end, so none is missed
RUN = 1 << 16  # pieces of a split that are jumped through on arrays
SENT = 200_000  # groups of equal payloads (about 100 bytes each) that are broadcast; more are joined
SALTS = 16
LEAST = 100  # bytes of a payload that may be given as a revisit


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a pair whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")), F.lit("")) for k, v in pairs])


def write_archives(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", records_per_file: int = 2000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row, in gzip files of at most records_per_file records.

    Of equal payloads of LEAST bytes or more, the one with the smallest page_id is a response, the others
    revisit it (headers only). A null html is the empty payload. Rows that share that smallest page_id are
    all responses; a row without page_id revisits if its payload has a page with one."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("digest"))
    first = rows.filter(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stored(first, "first")
    if first.count() <= SENT:
        rows = rows.join(F.broadcast(first), "digest", "left")
    else:  # a payload that very many pages have is dealt over SALTS tasks
        salted = first.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes").cast("string"))), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _lines(
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", urn(F.col("page_id"))),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(again, urn(F.col("first")))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _page(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return found[1] if found else None


#: ids stay text until the end: pandas would make floating-point numbers of long columns with nulls
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
PIECE = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("size", pa.int64()), ("leads", pa.bool_()), ("reach", pa.int64()), ("whole", pa.bool_()), ("piece", pa.binary())]
    + [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


NOTHING = None, -1, None, None, None


def _record(head: bytes, block: bytes) -> tuple:
    """RECORD from header lines and content."""
    kind, http_end = _field(head, b"WARC-Type"), block.find(b"\r\n\r\n") + 4
    if kind == "revisit":
        size = int(_field(block[:http_end], b"Content-Length") or 0)
        digest = (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha256:")
    else:
        size = len(block) - http_end if http_end > 3 else 0
        digest = hashlib.sha256(block[len(block) - size :]).hexdigest()
    return _page(_field(head, b"WARC-Record-ID")), size, digest, kind, _page(_field(head, b"WARC-Refers-To"))


def candidate(piece: bytes) -> tuple:
    """Of what follows a CUT (or begins a file): whether it has the magic itself; how far its end is from the
    magic (-1: no record begins here); whether the piece holds the whole record; then what the record says."""
    leads = piece.startswith(MAGIC)
    at = len(MAGIC) if leads else 0
    end = piece.find(b"\r\n\r\n", at)
    length = _field(piece[at:end], b"Content-Length") if end >= 0 and piece[at : at + 3] in (b"0\r\n", b"1\r\n") else None
    if not length or not length.isdigit():
        return leads, -1, False, *NOTHING
    start, n = end + 4, int(length)
    rest = len(piece) - start - n  # the last line feed before a CUT is part of it
    whole = rest in (3, 4) and piece[start + n :] == b"\r\n\r\n"[:rest]
    if rest >= 0 and not whole:
        return leads, -1, False, *NOTHING
    reach = start - at + len(MAGIC) + n + 4
    return leads, reach, whole, *(_record(piece[at:end], piece[start : start + n]) if whole else NOTHING)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", CUT.decode()).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 3):
        bodies = b.column(3).to_pylist()
        found = [list(x) for x in zip(*map(candidate, bodies), strict=True)] or [[]] * 8
        fields = [list(map(len, bodies)), *found[:3], [hashlib.sha256(x).digest() for x in bodies], *found[3:]]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, f.type) for x, f in zip(fields, list(PIECE)[3:], strict=True))], schema=PIECE)


def _jumps(starts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Index in starts (sorted) of each successor; len(starts) if it is none of them."""
    at = np.searchsorted(starts, successors)
    return np.where((at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == successors), at, len(starts))


PLACED = "file string, block long, run long, file_bytes long, start long, successor long, leaves long, whole boolean, piece binary, " + RECORD


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """Start and successor in the file of each piece of a run, and where its chain leaves the run (-1: nowhere)."""
    rows = rows.sort_values("seq")
    step = rows["size"].to_numpy(np.int64) + len(CUT)
    at = rows["base"].to_numpy(np.int64) + np.cumsum(step) - step
    starts = np.where(at == 0, 0, at - len(MAGIC))
    good = (rows["reach"].to_numpy(np.int64) >= 0) & (rows["leads"].to_numpy(bool) == (at == 0))
    successors = np.where(good, starts + rows["reach"].to_numpy(np.int64), -1)
    n = len(rows)
    jump = np.append(_jumps(starts, successors), n)
    outside = (successors > starts[-1]) | (successors < 0)
    leaves = np.append(np.where(outside, successors, -1), 0)
    last = np.arange(n + 1)  # the last place of the run on each chain
    hop = np.where(jump < n, jump, last)
    for _ in range(n.bit_length()):
        last, hop = hop[last], hop[hop]
    return rows.assign(start=starts, successor=successors, leaves=leaves[last[:n]])[_names(PLACED)]


def _reached(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The rows of a run with whether the chain that enters it reaches them."""
    rows = rows.sort_values("start")
    n, seen = len(rows), np.zeros(len(rows) + 1, bool)
    starts = rows["start"].to_numpy(np.int64)
    seen[_jumps(starts, entries["start"].to_numpy(np.int64))] = True
    jump = np.append(_jumps(starts, rows["successor"].to_numpy(np.int64)), n)
    for _ in range(n.bit_length() + 1):
        seen[jump[seen]] = True
        jump = jump[jump]
    return rows.assign(reached=seen[:n])[_names(REACHED)]


def _alone(rows: pd.DataFrame) -> pd.DataFrame:
    """The same for a file of one run, which its chain enters at its start."""
    return _reached(_placed(rows), pd.DataFrame({"start": [0]}))


REACHED = "file string, start long, successor long, whole boolean, piece binary, reached boolean, " + RECORD


def _raise_if_broken(files: DataFrame, ends: DataFrame) -> None:
    """files: file, file_bytes. Raises if one of them isn't among the ends that chains reach."""
    if broken := files.join(ends, ["file", "file_bytes"], "left_anti").count():
        raise ValueError(f"the chain of records breaks off in {broken} files")


def _chained(placed: DataFrame) -> DataFrame:
    """file, block, run, start: where the chain of each file enters its runs. Raises if one breaks off."""
    files = placed.groupBy("file").agg(F.first("file_bytes").alias("file_bytes"))
    nodes = placed.filter("leaves >= 0").select("file", F.col("leaves").alias("start")).unionByName(files.select("file", F.lit(0).cast("long").alias("start"))).distinct()
    jump = stored(placed.join(nodes, ["file", "start"]).select("file", "start", F.col("leaves").alias("to"), "block", "run"), "jumps")
    most = jump.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    steps, seen = jump.select("file", "start", "to"), files.select("file", F.lit(0).cast("long").alias("start"))
    for _ in range(int(most).bit_length()):
        ahead = seen.join(steps, ["file", "start"]).select("file", F.col("to").alias("start"))
        seen = stored(seen.unionByName(ahead).distinct(), "seen")
        onward = steps.select("file", F.col("to").alias("then"), F.col("start").alias("to"))
        steps = stored(steps.join(onward, ["file", "to"], "left").select("file", "start", F.coalesce("then", "to").alias("to")), "steps")
    _raise_if_broken(files, seen.withColumnRenamed("start", "file_bytes"))
    return jump.join(seen, ["file", "start"]).select("file", "block", "run", "start")


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """The record of the pieces of one payload."""
    data = CUT.join(rows.sort_values("at")["body"])
    leads = data.startswith(MAGIC)
    at = len(MAGIC) if leads else 0
    end = data.find(b"\r\n\r\n", at)
    start, n = end + 4, int(_field(data[at:end], b"Content-Length"))
    if data[start + n :] not in (b"\r\n\r", b"\r\n\r\n"):
        raise ValueError("a record has no end")
    return pd.DataFrame([_record(data[at:end], data[start : start + n])], columns=_names(RECORD))


def read_archives(spark: SparkSession, path: str, cell: int = 1 << 26) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the files in path.

    Files whose name ends in .gz are unpacked, all members of them (one that is cut off raises an error), by
    one task each; others are read in splits. Groups are runs of RUN pieces or single records, never files.
    A file whose chain doesn't reach its end raises an error; no file, no row. Pieces of a record are looked
    up in cells of that many bytes of the file."""
    found = stored(_pieces(spark, path).mapInArrow(_scan, from_arrow_schema(PIECE)).withColumn("run", F.shiftright("seq", RUN.bit_length() - 1)), "pieces")
    runs = found.groupBy("file", "block", "run").agg((F.sum("size") + F.count("*") * len(CUT)).alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by file order by block, run rows between unbounded preceding and 1 preceding), 0)")
    runs = stored(runs.select("file", "block", "run", before.alias("base"), F.expr(f"sum(n) over (partition by file) - {len(CUT)}").alias("file_bytes"), F.expr("count(*) over (partition by file)").alias("runs")), "runs")
    run, one = ["file", "block", "run"], F.col("runs") == 1
    # the chain of a file of one run is settled there; those of others are joined
    marked = stored(found.join(runs.filter(one), run).groupBy(*run).applyInPandas(_alone, REACHED), "marked")
    ends = marked.filter("reached").groupBy("file").agg(F.max("successor").alias("file_bytes"))
    _raise_if_broken(runs.filter(one).select("file", "file_bytes"), ends)
    if not runs.filter(~one).isEmpty():
        placed = stored(found.join(runs.filter(~one), run).groupBy(*run).applyInPandas(_placed, PLACED), "placed")
        entries = _chained(placed)
        marked = marked.unionByName(stored(placed.groupBy(*run).cogroup(entries.groupBy(*run)).applyInPandas(_reached, REACHED), "marked"))
    numbers = lambda df: df.select(*[F.col(c).cast("long") if c in ("page_id", "refers_to") else c for c in _names(RECORD)])
    out = numbers(marked.filter("reached and whole"))
    parts = marked.filter("reached and not whole").select("file", "start", "successor", "piece")
    if parts.isEmpty():
        return out
    # payloads in pieces: the pieces from a record's start on that are no record
    wide = parts.select("file", F.col("start").alias("record"), "successor", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("successor") / cell))).alias("cell"))
    inner = marked.filter("not reached").select("file", F.floor(F.col("start") / cell).alias("cell"), F.col("start").alias("at"), "piece")
    inner = inner.join(wide, ["file", "cell"]).filter("at > record and at < successor").select("file", "record", "at", "piece")
    wanted = stored(inner.unionByName(parts.select("file", F.col("start").alias("record"), F.col("start").alias("at"), "piece")), "parts")
    bodies = _pieces(spark, path).select(F.unhex(F.sha2("body", 256)).alias("piece"), "body").join(wanted.select("piece").distinct(), "piece", "left_semi").dropDuplicates(["piece"])
    return out.unionByName(numbers(wanted.join(bodies, "piece").groupBy("file", "record").applyInPandas(_joined, RECORD)))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages as archives (to path, else into the shared folder) and reads them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
