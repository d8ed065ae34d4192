"""Many terms in texts: all of them by one automaton, then of each group those that a reader from the left would take,
the longest first."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .core import cut

SHARD = 2_000_000  # characters of terms that one automaton holds, about
ROWS = 1 << 13  # of a batch that goes out
SLICE = 4 << 20  # bytes of text that a task turns into Python objects at a time, or one text if it is longer

HITS = "row string, group_id string, start int, size int, candidate string"


def _chosen(hits: Iterable[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Of hits (start, -size, term), in that order, those that don't begin within one before."""
    end = 0
    for start, less, term in hits:
        if start >= end:
            end = start - less
            yield start, -less, term


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about SLICE bytes of that column, or one row that is longer."""
    for whole in batches:
        rows = max(1, whole.num_rows * SLICE // max(SLICE, whole.column(column).nbytes))
        yield from (whole.slice(i, rows) for i in range(0, whole.num_rows, rows))


def _automaton(terms: list[tuple[str, list[str]]]) -> ahocorasick.Automaton | None:
    automaton = ahocorasick.Automaton()
    for term, groups in terms:
        automaton.add_word(term, (term, groups))
    if not terms:
        return None
    automaton.make_automaton()
    return automaton


def _hits(automaton: ahocorasick.Automaton | None, text: str | None) -> dict[str, list[tuple[int, int, str]]]:
    """Of each group all hits (start, -size, term) in a text, in that order."""
    found = defaultdict(list)
    for end, (term, groups) in automaton.iter(text or "") if automaton else ():
        for g in groups:
            found[g].append((end + 1 - len(term), -len(term), term))
    for hits in found.values():
        hits.sort()
    return found


def _scan(texts: DataFrame, terms: list[tuple[str, list[str]]], settle: bool) -> DataFrame:
    """Hits of terms (term, its groups) in texts (row, text); settle: only those that are chosen."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)

        def rows() -> Iterator[tuple]:
            for b in _slices(batches, 1):
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for g, hits in _hits(automaton, text).items():
                        yield from ((row, g, start, size, term) for start, size, term in (_chosen(hits) if settle else ((s, -n, t) for s, n, t in hits)))

        yield from map(_batch, batched(rows(), ROWS))

    return texts.mapInArrow(each, HITS)


def _pieces(text: str | None, hits: Iterable[tuple[int, int]]) -> list[str | None]:
    """The text cut at hits (start, size): they and what lies between them; the text itself without any."""
    found, end = [], 0
    for start, size in hits:
        found += [text[end:start], text[start : start + size]]
        end = start + size
    return [p for p in (*found, text[end:]) if p] if found else [text]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of hits in the order of row, group, start and descending size the chosen ones."""
    key, end = None, 0
    for b in batches:
        out = []
        for r in b.to_pylist():
            if key != (r["row"], r["group_id"]):
                key, end = (r["row"], r["group_id"]), 0
            if r["start"] >= end:
                end = r["start"] + r["size"]
                out.append(tuple(r.values()))
        yield _batch(out)


def _sized(rules: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """candidate and its groups, once each, and how many automata they make."""
    rules = cut(rules.filter(F.col("candidate") != "").groupBy("candidate").agg(F.collect_set("group_id").alias("groups")))  # of a term: few
    total = rules.agg(F.coalesce(F.sum(F.length("candidate")), F.lit(0))).first()[0]
    return rules, max(1, -(-total // shard))


def _terms(rules: DataFrame) -> list[tuple[str, list[str]]]:
    return [(r["candidate"], sorted(r["groups"])) for r in rules.collect()]  # SHARD characters, about


def find_terms(df: DataFrame, rules: DataFrame, text_col: str = "column_description", id_col: str = "source_id", shard: int = SHARD) -> DataFrame:
    """The id of df's rows, group_id, candidate and start (from 0) of each occurrence of a term in the text. rules:
    group_id, candidate. Of a group's terms the leftmost counts, of those that begin together the longest, and none
    that begins within one that counts. Null and empty terms, and null texts, have none.

    Rules of any number: about `shard` characters of them make an automaton, and there are as many as it takes. If one
    is enough, texts aren't shuffled or stored; with more, only what was found is."""
    rules, n = _sized(rules, shard)
    ident = F.col(id_col).cast("string")
    texts = df.select(ident.alias("id"), F.col(text_col).alias("text"), ident.alias("row"))
    if n > 1:  # rows that repeat an id stay apart
        texts = cut(texts.withColumn("row", F.monotonically_increasing_id().cast("string")))
    hits = None
    for i in range(n):
        own = rules.filter(F.pmod(F.xxhash64("candidate"), F.lit(n)) == i) if n > 1 else rules
        some = _scan(texts.select("row", "text"), _terms(own), n == 1)
        hits = some if hits is None else hits.unionByName(some)
    if n > 1:
        hits = hits.repartition("row", "group_id").sortWithinPartitions("row", "group_id", "start", F.desc("size")).mapInArrow(_settled, HITS)
        hits = hits.join(texts.select("row", "id"), "row").withColumn("row", F.col("id"))
    return hits.select(F.col("row").alias(id_col), "group_id", "candidate", "start")


def cut_at_terms(df: DataFrame, candidates: DataFrame, text_col: str, shard: int = SHARD) -> DataFrame:
    """df with units: the text cut at the candidates that find_terms finds in it. With one automaton a row is cut where
    it is read, and nothing is shuffled; with more, rows meet the places that were found in them by their number."""
    spark, rules = df.sparkSession, candidates.select(F.lit("").alias("group_id"), "candidate")
    sized, n = _sized(rules, shard)
    rows = df
    if n > 1:
        rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        found = find_terms(rows, rules, text_col, "_row", shard).select(F.col("_row").cast("long").alias("_row"), F.struct("start", F.length("candidate").alias("size")).alias("hit"))
        rows = rows.join(found.groupBy("_row").agg(F.array_sort(F.collect_list("hit")).alias("_at")), "_row", "left").select(*df.columns, "_at")
    sent = spark.sparkContext.broadcast(_terms(sized) if n == 1 else [])
    names = list(df.columns)
    width, at = len(names), names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for b in _slices(batches, at):
            texts = b.column(at).to_pylist()
            if n == 1:
                places = ([h[:2] for h in _chosen(_hits(automaton, t).get("", ()))] for t in texts)
            else:
                places = ([(h["start"], h["size"]) for h in hits or ()] for hits in b.column(width).to_pylist())
            units = pa.array([_pieces(t, p) for t, p in zip(texts, places, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], units], names=[*names, "units"])

    return rows.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField("units", T.ArrayType(T.StringType()))]))
