"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

SLICE = 4 << 20  # bytes of text that a task turns into Python objects at a time, or one text if it is longer


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master (tests); on a
    cluster, where executors would not see it, an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: All that one driver stores lies in a folder of this name, within the shared one.
RUN = f"attrium-{uuid.uuid4().hex}"
_within = [RUN]  # where new tables go: the last


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_within[-1]}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession) -> None:
    """Deletes all that this driver has stored; results that are still to be computed from it are lost."""
    delete(spark, f"{shared_dir(spark)}/{RUN}")


def kept(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """What make gives, as a table, and its folder; all that was stored to make it goes."""
    path, scratch = new_path(spark, label), f"{_within[-1]}/scratch-{uuid.uuid4().hex}"
    _within.append(scratch)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _within.pop()
        delete(spark, f"{shared_dir(spark)}/{scratch}")
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that has over 1 / HOT_KEYS of all rows is hot; so there are at most so many.
HOT_KEYS = 10_000


def join_unique(rows: DataFrame, by_key: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows joined with by_key, which has each key once. counts: key, n, the rows of each key. What belongs to
    hot keys (HOT_KEYS rows at most, whatever the input) is broadcast, so that none of them fills one task."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(by_key.join(F.broadcast(counts.filter(F.col("n") > total / HOT_KEYS).select(key)), key, "left_semi"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(by_key, key)
    return rows.join(hot, key).unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about SLICE bytes of that column, or one row that is longer."""
    for whole in batches:
        rows = max(1, whole.num_rows * SLICE // max(SLICE, whole.column(column).nbytes))
        yield from (whole.slice(i, rows) for i in range(0, whole.num_rows, rows))


def append_columns(df: DataFrame, text: Column | tuple[str, ...], fn: Callable[[list], list[list]], schema: pa.Schema) -> DataFrame:
    """df with the fields of schema after its columns. fn gets the values of `text` in a batch and gives,
    for each field, the list (or Arrow array) of its values. Other columns pass through as they are. text: an expression,
    or a column's name and those of fields within it, of which nothing is sent to Python twice."""
    names = list(df.columns)
    path, own = (text, None) if isinstance(text, tuple) else (("_appended_from",), text)
    while own is not None and path[0] in names:
        path = (path[0] + "_",)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = whole.column(path[0])
            for field in path[1:]:
                found = pc.struct_field(found, field)
            rows = max(1, whole.num_rows * SLICE // max(SLICE, found.nbytes))
            for i in range(0, whole.num_rows, rows):
                b, values = whole.slice(i, rows), found.slice(i, rows).to_pylist()
                new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(fn(values), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *new], names=[*names, *schema.names])

    sent = df if own is None else df.select("*", own.alias(path[0]))
    return sent.mapInArrow(each, T.StructType([*df.schema.fields, *from_arrow_schema(schema).fields]))
