"""Progress logs as a stream: what each new entry changes in the durations of stages."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "job long, stage string, micros long, entries long"
STATE = "ts array<long>, stage array<string>"


def _entered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state holds a job's entries in order (stages and their repetitions: some hundreds). A new entry takes the
    time up to the next one from the entry before it, wherever it falls; so late ones change what is past, too."""
    known = list(zip(*state.get, strict=True)) if state.exists else []
    out = []
    for b in batches:
        for ts, stage in zip(b["ts"].tolist(), b["stage"].tolist(), strict=True):
            entry = (int(ts), stage)
            insort(known, entry)
            at = known.index(entry)
            after = known[at + 1][0] - entry[0] if at + 1 < len(known) else 0
            out.append((key[0], stage, after, 1))
            if at:
                before = known[at - 1]
                was = known[at + 1][0] - before[0] if at + 1 < len(known) else 0
                out.append((key[0], before[1], entry[0] - before[0] - was, 0))
    state.update(([t for t, _ in known], [s for _, s in known]))
    yield pd.DataFrame(out, columns=["job", "stage", "micros", "entries"])


def stage_durations_stream(spark: SparkSession, log: str, schema: str, out: str, checkpoint: str):
    """Reads an append-only JSON log (job, stage, ts) as a stream; each trigger reads new files only, and adds to out
    what they change."""
    rows = spark.readStream.schema(schema).json(log).select("job", "stage", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    changes = rows.groupBy("job").applyInPandasWithState(_entered, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
    return changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_durations(changes: DataFrame) -> DataFrame:
    """job, stage, seconds and entries, as core.stage_durations has them, from what the stream has put out."""
    return changes.groupBy("job", "stage").agg((F.sum("micros") / 1e6).alias("seconds"), F.sum("entries").alias("entries"))
