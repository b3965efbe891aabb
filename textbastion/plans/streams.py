"""Queries that run the streaming operators over the planted events, as far as they have come."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.planting import plant_events
from ..streaming import state as S
from . import state as batch

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_TAINTS = batch._TAINTS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def events(spark, d):
    """A stream of the planted events."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return plant_events(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*"))


@query("taint_stream", batch.ORACLE_SQL["taint_replay"])
def taint_stream(spark, d):
    s = S.replay(events(spark, d), F.expr(_TAINTS), F.col("hook_event_name") == "UserPromptSubmit")
    return S.drain(spark, s).select("event_id", "tainted")


@query("state_stream", batch.ORACLE_SQL["state_replay"])
def state_stream(spark, d):
    s = S.replay(events(spark, d), F.expr(_TAINTS), F.col("hook_event_name") == "UserPromptSubmit")
    return S.drain(spark, s).select("event_id", "state")


@query("scan_cache_stream", f"{batch.WITH} SELECT DISTINCT sha256(content || chr(1) || path) AS key FROM ev")
def scan_cache_stream(spark, d):
    """Keys that have to be scanned; the planted events lie within the time to live of each other in one batch."""
    keyed = events(spark, d).select(F.sha2(F.concat("content", F.lit("\u0001"), "path"), 256).alias("key"), "ts")
    return S.drain(spark, S.uncached(keyed)).select("key")
