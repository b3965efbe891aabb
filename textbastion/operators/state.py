"""Project state, review caches and taint as tables: point lookups are left joins, caches anti joins, last writes max_by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN, MONITORED, IGNORED = "unknown", "monitored", "ignored"
TTL_DAYS = 30


def latest_state(commands: DataFrame) -> DataFrame:
    """(repo, state) from (repo, ts, event_id, command): the last of ignore, monitor and reset wins, by event_id among equal times; a reset repo has no row."""
    last = commands.groupBy("repo").agg(F.max_by("command", F.struct("ts", "event_id")).alias("command"))
    return last.where("command <> 'reset'").select("repo", F.when(F.col("command") == "ignore", IGNORED).when(F.col("command") == "monitor", MONITORED).otherwise(UNKNOWN).alias("state"))


def replay(commands: DataFrame) -> DataFrame:
    """Each command (repo, ts, event_id, command) with the state it leaves: ``before`` and ``state``; a reset leaves unknown."""
    order = Window.partitionBy("repo").orderBy("ts", "event_id")
    state = F.when(F.col("command") == "ignore", IGNORED).when(F.col("command") == "monitor", MONITORED).otherwise(UNKNOWN)
    return commands.withColumn("state", state).withColumn("before", F.coalesce(F.lag("state").over(order), F.lit(UNKNOWN)))


def lookup_state(df: DataFrame, states: DataFrame, repo: str = "repo") -> DataFrame:
    """Adds ``state``, unknown where there is no row."""
    return df.join(states.withColumnRenamed("repo", repo), repo, "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))


def reset(table: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of a state or cache table that stay when ``repos`` are reset."""
    return table.join(repos, "repo", "left_anti")


def cache_lookup(keys: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``code`` to each key that the cache holds and that is not older than the time to live (30 days to the second is still a hit)."""
    fresh = cache.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(TTL_DAYS)))
    return keys.join(fresh.select("key", "code"), "key", "left")


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with new results (key, code, ts); the newest of a key stays, the larger code among equal times; errors are not cached."""
    return cache.unionByName(results.where("code >= 0")).groupBy("key").agg(F.max_by("code", F.struct("ts", "code")).alias("code"), F.max("ts").alias("ts"))


def cache_prune(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(TTL_DAYS)))


def unreviewed(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Files (repo, path, hash, ..) whose content has not been reviewed."""
    return files.join(reviewed.select("repo", "path", "hash").distinct(), ["repo", "path", "hash"], "left_anti")


def first_of(events: DataFrame, wanted: Column) -> DataFrame:
    """(project, first): time and event_id of the first wanted event; one row a project with a map-side part, whatever a project's events are."""
    return events.where(wanted).groupBy("project").agg(F.min(F.struct("ts", "event_id")).alias("first"))


def taint_replay(events: DataFrame, taints: Column) -> DataFrame:
    """Adds ``tainted``: whether an earlier event of the project tainted it. Ties in time are in event_id order."""
    out = events.join(first_of(events, taints), "project", "left")
    return out.withColumn("tainted", F.coalesce(F.struct("ts", "event_id") > F.col("first"), F.lit(False))).drop("first")


def auto_monitor_replay(events: DataFrame, prompt: Column) -> DataFrame:
    """Adds ``state``: the first prompt of a project makes it monitored for that and all later events."""
    out = events.join(first_of(events, prompt), "project", "left")
    return out.withColumn("state", F.when(F.struct("ts", "event_id") >= F.col("first"), MONITORED).otherwise(UNKNOWN)).drop("first")


def sessions(requests: DataFrame, idle: str) -> DataFrame:
    """(start, end, n): runs of requests that end when none comes for ``idle``. Runs within each day come first, then what no time-out parts is joined.

    The second step sees one row for each run within a day, a number that grows with the days and the pauses and not with the requests.
    """
    gap = F.expr(f"INTERVAL {idle}")
    day = Window.partitionBy("day").orderBy("ts")
    q = requests.where("ts IS NOT NULL").select("ts", F.to_date("ts").alias("day"))
    new = F.when(F.col("ts") <= F.lag("ts").over(day) + gap, 0).otherwise(1)
    runs = q.withColumn("new", new).withColumn("run", F.sum("new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("day", "run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    every = Window.orderBy("first")
    joined = runs.withColumn("new", F.when(F.col("first") <= F.lag("last").over(every) + gap, 0).otherwise(1))
    joined = joined.withColumn("g", F.sum("new").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("g").agg(F.min("first").alias("start"), (F.max("last") + gap).alias("end"), F.sum("n").alias("n")).drop("g")
