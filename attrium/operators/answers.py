"""Answers of a model, written once.

A run has a folder with a table of answers for each round. While a round is asked, each batch leaves its answer in a
file of its own as soon as the model has given it. A task that runs again takes it from there, and so does a run that
goes on where another was broken off. When a round is through, its answers are a table that every reader shares."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .core import batch_rows, missing, shared_folder

SCHEMA = "batch string, source_ids array<string>, answer string, failure_code string"


def failure_code(error: BaseException) -> str:
    """The class of a failed call: timeout, connection_error, response_error, model_error or unexpected_error."""
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, ConnectionError):
        return "connection_error"
    if isinstance(error, ValueError):  # an answer that can't be read
        return "response_error"
    return "model_error" if isinstance(error, RuntimeError) else "unexpected_error"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, as tasks open it, and the folder's path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _asked(folder: str, name: str, ask: Callable[[], dict]) -> dict:
    """What the file says, or else what ask gives, which is left in the file. Of two that ask at once the one that
    comes first is taken by both."""
    store, root = _store(folder)
    path = f"{root}/{name}.json"

    def read() -> dict | None:
        if store.get_file_info(path).type != pafs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    if (found := read()) is not None:
        return found
    given, own = ask(), f"{root}/{name}.{uuid.uuid4().hex}"
    store.create_dir(root)
    with store.open_output_stream(own) as f:
        f.write(json.dumps(given, ensure_ascii=False).encode())
    if (found := read()) is not None:
        store.delete_file(own)
        return found
    store.move(own, path)
    return given


def _whole(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of rows that come in their order; one may lie across frames."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if frame.empty:
            continue
        last = frame["batch"] == frame["batch"].iloc[-1]
        for _, part in frame[~last].groupby("batch", sort=False):
            yield part.reset_index(drop=True)
        rest = frame[last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


class Answers:
    """The answers of one run. folder: where an earlier run left them, or where this one shall; by default a new one in
    the shared folder. It must be one that pyarrow opens on all executors."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}").rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def of(self, round_: int) -> DataFrame:
        """The answers of a round that are in: batch, source_ids, answer, failure_code."""
        path, store = self._path(f"round-{round_}")
        parts = [str(x.getPath()) for x in (store.listStatus(path) if store.exists(path) else []) if store.exists(self._path(f"round-{round_}", x.getPath().getName(), "_SUCCESS")[0])]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def ask(self, requests: DataFrame, model: Callable[[pd.DataFrame], Iterable[str]], round_: int = 0, batch: int = 20, attempts: int = 2) -> DataFrame:
        """The answers of the round, with those to requests (source_id, row_no, request) that weren't in before.

        model gives one answer for a table of at most `batch` requests, and is asked up to `attempts` times if it
        fails. A failure is an answer, too: it stays the batch's own, and is left to the next round. A request of which
        the round has an answer isn't asked again, whatever happens to tasks or to the run."""
        known = self.of(round_).select(F.explode("source_ids").alias("source_id"))
        todo = missing(requests, known)
        n = todo.count()
        if not n:
            return self.of(round_)
        # some batches to a task: models are slow, so that their number decides and not the size of the requests, by which
        # Spark would put them into a task or two
        buckets = max(1, -(-n // (16 * batch)))
        tasks = min(buckets, max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = batch_rows(todo, batch, buckets).select("batch", "row_no", "source_id", "request").repartition(tasks, "batch").sortWithinPartitions("batch", "row_no", "source_id")
        pending = f"{self.folder}/pending-{round_}"

        def answered(part: pd.DataFrame) -> tuple:
            ids = part["source_id"].tolist()
            name = hashlib.sha256(json.dumps([ids, part["request"].tolist()]).encode()).hexdigest()

            def ask() -> dict:
                code = ""
                for _ in range(attempts):
                    try:
                        return {"answer": "".join(model(part)), "failure_code": ""}
                    except Exception as error:  # a model may fail in any way; the code says how
                        code = failure_code(error)
                return {"answer": None, "failure_code": code}

            found = _asked(pending, name, ask)
            return part["batch"].iloc[0], ids, found["answer"], found["failure_code"]

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in batched(map(answered, _whole(frames)), 64):
                yield pd.DataFrame(some, columns=["batch", "source_ids", "answer", "failure_code"])

        rows.mapInPandas(each, SCHEMA).write.parquet(f"{self.folder}/round-{round_}/part-{uuid.uuid4().hex}")
        path, store = self._path(f"pending-{round_}")
        store.delete(path, True)
        return self.of(round_)
