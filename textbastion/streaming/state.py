"""Structured Streaming twins of ``operators.state``.

State is kept by project (or key), so it is dealt over the executors and bounded by the projects, not by their events. Events of a
micro-batch are taken in order of (ts, event_id); between batches the order of arrival holds, as for processes that share a file.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import MONITORED, TTL_DAYS, UNKNOWN


def replay(events: DataFrame, taints: Column, prompt: Column) -> DataFrame:
    """(event_id, project, tainted, state) of a stream of events: ``tainted`` by an earlier event of the project, monitored from its first prompt on."""
    rows = events.select("project", "event_id", "ts", F.coalesce(taints, F.lit(False)).alias("taints"), F.coalesce(prompt, F.lit(False)).alias("prompt"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tainted, monitored = state.get if state.exists else (False, False)
        all_ = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        before = all_.taints.cummax().shift(1, fill_value=False).astype(bool) | bool(tainted)
        seen = all_.prompt.cummax().astype(bool) | bool(monitored)
        state.update((bool(tainted or all_.taints.any()), bool(monitored or all_.prompt.any())))
        yield pd.DataFrame({"event_id": all_.event_id, "project": key[0], "tainted": before, "state": seen.map({True: MONITORED, False: UNKNOWN})})

    return rows.groupBy("project").applyInPandasWithState(step, "event_id long, project long, tainted boolean, state string", "tainted boolean, monitored boolean", "append", GroupStateTimeout.NoTimeout)


def uncached(requests: DataFrame) -> DataFrame:
    """Requests (key, ts, ..) whose key has not come within the time to live: what has to be scanned. Older keys leave the state by the watermark."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{TTL_DAYS} days").dropDuplicatesWithinWatermark(["key"])


def sessions(requests: DataFrame, idle: str, late: str = "10 minutes") -> DataFrame:
    """(project, start, end, n): runs of a project's requests that end when none comes for ``idle``."""
    w = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("project", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet in the shared folder, and read that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"  # one machine
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
