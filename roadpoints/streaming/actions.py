"""The edit-action log, as batch DataFrames and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "session_id long, ord long, ts timestamp, action string, category string, x double, y double"
CONTEXT = "session_id long, ord long, relative_time double, edits long, edit_rate double"
CURRENT = "session_id long, category string, x double, y double, action string"


def session_context(actions: DataFrame, block: int = 1 << 14) -> DataFrame:
    """Time since the session's first action, running edit count and edits per minute, for each action.

    A long session is counted in blocks of its time order, so it never sits in one task.
    """
    start = actions.groupBy("session_id").agg(F.min("ts").alias("_t0"))
    a = actions.join(start, "session_id").withColumn("relative_time", (F.unix_micros("ts") - F.unix_micros("_t0")) / 1e6)
    a = a.withColumn("_b", F.floor(F.col("relative_time") / 3600))
    n = a.groupBy("session_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("session_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rn = F.row_number().over(Window.partitionBy("session_id", "_b").orderBy("ts", "ord"))
    out = a.join(n, ["session_id", "_b"]).withColumn("edits", rn + F.col("_s")).drop("_b", "_s", "_t0")
    return out.withColumn("edit_rate", F.col("edits") / F.greatest("relative_time", F.lit(1.0)) * 60)


def current_points(actions: DataFrame) -> DataFrame:
    """Points whose last action is an addition."""
    k = ["session_id", "category", "x", "y"]
    return actions.groupBy(*k).agg(F.max_by("action", F.struct("ts", "ord")).alias("action")).where("action = 'add'").drop("action")


def read_actions(spark: SparkSession, path: str, files_per_trigger: int = 16, delay: str = "10 minutes") -> DataFrame:
    """Stream of action files in Parquet with a watermark."""
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withWatermark("ts", delay))


def activity(stream: DataFrame, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Actions per tumbling or sliding window (an addition: the desktop tool has no windows)."""
    return stream.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "action").agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy("session_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("edits"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def _count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, n = state.get if state.exists else (None, 0)
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "ord"])
        t = pdf["ts"].astype("int64") // 1000
        first = int(t.iloc[0]) if first is None else min(first, int(t.iloc[0]))
        rel = (t - first) / 1e6
        edits = pd.RangeIndex(n + 1, n + 1 + len(pdf))
        n += len(pdf)
        yield pd.DataFrame({"session_id": key[0], "ord": pdf["ord"].to_numpy(), "relative_time": rel.to_numpy(), "edits": edits, "edit_rate": edits / rel.clip(lower=1.0).to_numpy() * 60})
    state.update((first, n))


def stream_context(stream: DataFrame) -> DataFrame:
    """Running context per session in a stream; the state is two numbers per session, whatever its length."""
    return stream.groupBy("session_id").applyInPandasWithState(_count, CONTEXT, "first long, n long", "append", GroupStateTimeout.NoTimeout)


def _last(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get if state.exists else (-1, -1, "")
    for pdf in batches:
        row = pdf.sort_values(["ts", "ord"]).iloc[-1]
        now = (int(row["ts"].value // 1000), int(row["ord"]), row["action"])
        seen = max(seen, now)
    state.update(seen)
    yield pd.DataFrame({"session_id": [key[0]], "category": [key[1]], "x": [key[2]], "y": [key[3]], "action": [seen[2]]})


def stream_current_points(stream: DataFrame) -> DataFrame:
    """Last action per place as updates; a removal is a row with action remove (a tombstone)."""
    return stream.groupBy("session_id", "category", "x", "y").applyInPandasWithState(_last, CURRENT, "t long, o long, action string", "update", GroupStateTimeout.NoTimeout)


def process_files(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a batch job on each micro-batch and append its result and a status row, once per batch id."""
    def one(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.agg(F.count(F.lit(1)).alias("rows"), F.lit("done").alias("status")).write.mode("overwrite").parquet(f"{out}_status/batch={batch_id}")
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
