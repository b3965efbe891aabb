"""Queries on state, caches, taint and sessions, over tables derived from the planted events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from ..sources.planting import EVENTS_SQL, PLANTED_SQL, hook_events, planted
from .text import SQL_VERDICT

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


WITH = f"WITH ev AS ({EVENTS_SQL}) "
#: Commands on projects: one event in four.
COMMAND = "CASE event_id % 12 WHEN 0 THEN 'ignore' WHEN 4 THEN 'monitor' WHEN 8 THEN 'reset' END"
CMDS = f"{WITH}, cmds AS (SELECT project AS repo, ts, event_id, {COMMAND} AS command FROM ev WHERE event_id % 4 = 0)"
LATEST = "latest AS (SELECT repo, CASE command WHEN 'ignore' THEN 'ignored' ELSE 'monitored' END AS state FROM (SELECT repo, arg_max(command, (ts, event_id)) AS command FROM cmds GROUP BY repo) WHERE command <> 'reset')"
AS_OF = "1998-06-01 00:00:00"


def cmds(spark, d):
    return hook_events(spark, d).where("event_id % 4 = 0").select(F.col("project").alias("repo"), "ts", "event_id", F.expr(COMMAND).alias("command"))


@query("repo_state_latest", f"{CMDS}, {LATEST} SELECT repo, state FROM latest")
def repo_state_latest(spark, d):
    return S.latest_state(cmds(spark, d))


@query("repos", f"{CMDS}, {LATEST} SELECT state, count(*) AS n FROM latest GROUP BY state")
def repos(spark, d):
    """How many projects there are in each state."""
    return S.latest_state(cmds(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("repo_admin", f"{CMDS}, {LATEST} SELECT p.repo, coalesce(state, 'unknown') AS state FROM (SELECT DISTINCT project AS repo FROM ev) p LEFT JOIN latest USING (repo)")
def repo_admin(spark, d):
    """The state of every project that has events."""
    every = hook_events(spark, d).select(F.col("project").alias("repo")).distinct()
    return S.lookup_state(every, S.latest_state(cmds(spark, d)))


_GUARD = "guard AS (SELECT DISTINCT project AS repo, path, sha256(content) AS hash FROM ev WHERE event_id % 3 = 0)"


@query("repo_reset", f"{CMDS}, {_GUARD} SELECT repo, path, hash FROM guard WHERE repo NOT IN (SELECT repo FROM cmds WHERE command = 'reset' AND repo % 5 = 0)")
def repo_reset(spark, d):
    """The review cache without the projects that were reset; of the planted resets those of one project in five are carried out, so that rows stay."""
    ev = hook_events(spark, d)
    guard = ev.where("event_id % 3 = 0").select(F.col("project").alias("repo"), "path", F.sha2("content", 256).alias("hash")).distinct()
    return S.reset(guard, cmds(spark, d).where("command = 'reset' AND repo % 5 = 0").select("repo").distinct())


_KEY = "sha256(content || chr(1) || path)"
_CACHE = f"cache AS (SELECT key, arg_max(code, epoch_us(ts) * 10 + code) AS code, max(ts) AS ts FROM (SELECT {_KEY} AS key, (event_id % 3 - 1)::INT AS code, ts FROM ev WHERE event_id % 2 = 0) WHERE code >= 0 GROUP BY key)"


def _results(spark, d, rest: int):
    key = F.sha2(F.concat("content", F.lit("\u0001"), "path"), 256)
    return hook_events(spark, d).where(f"event_id % 2 = {rest}").select(key.alias("key"), F.expr("int(event_id % 3 - 1)").alias("code"), "ts")


def _cache(spark, d):
    r = _results(spark, d, 0)
    return S.cache_put(r.where("1 = 0"), r)


_AS_OF = "(SELECT max(ts) - INTERVAL 10 DAY FROM ev)"


def _as_of(spark, d):
    # one row
    return F.lit(hook_events(spark, d).agg(F.max("ts")).first()[0]) - F.make_dt_interval(F.lit(10))


@query("scan_cache_put", f"{WITH}, {_CACHE} SELECT key, code, ts FROM cache")
def scan_cache_put(spark, d):
    return _cache(spark, d)


@query("scan_cache_prune", f"{WITH}, {_CACHE} SELECT key, code FROM cache WHERE ts >= {_AS_OF} - INTERVAL 30 DAY")
def scan_cache_prune(spark, d):
    return S.cache_prune(_cache(spark, d), _as_of(spark, d)).select("key", "code")


@query("scan_cache_lookup", f"{WITH}, {_CACHE} SELECT k.key, c.code FROM (SELECT DISTINCT {_KEY} AS key FROM ev) k LEFT JOIN (SELECT * FROM cache WHERE ts >= {_AS_OF} - INTERVAL 30 DAY) c ON k.key = c.key")
def scan_cache_lookup(spark, d):
    keys = hook_events(spark, d).select(F.sha2(F.concat("content", F.lit("\u0001"), "path"), 256).alias("key")).distinct()
    return S.cache_lookup(keys, _cache(spark, d), _as_of(spark, d))


@query("dedup_scan", f"WITH planted AS ({PLANTED_SQL}) SELECT doc_id, {SQL_VERDICT} AS verdict FROM planted")
def dedup_scan(spark, d):
    """Each distinct text is scanned once and its verdict joined back by hash."""
    from ..operators.scan import verdict

    p = planted(spark, d).select("doc_id", "text", F.sha2("text", 256).alias("key"))
    once = p.groupBy("key").agg(F.first("text").alias("text")).select("key", verdict(F.col("text")).alias("verdict"))
    return p.select("doc_id", "key").join(once, "key").select("doc_id", "verdict")


_TAINTS = "(hook_event_name = 'PostToolUse' AND contains(lower(content), 'ignore all'))"


@query("taint_replay", f"{WITH} SELECT event_id, coalesce(max({_TAINTS}::INT) OVER (PARTITION BY project ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS tainted FROM ev")
def taint_replay(spark, d):
    return S.taint_replay(hook_events(spark, d), F.expr(_TAINTS)).select("event_id", "tainted")


@query("state_replay", f"{WITH} SELECT event_id, CASE WHEN max((hook_event_name = 'UserPromptSubmit')::INT) OVER (PARTITION BY project ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 'monitored' ELSE 'unknown' END AS state FROM ev")
def state_replay(spark, d):
    return S.auto_monitor_replay(hook_events(spark, d), F.col("hook_event_name") == "UserPromptSubmit").select("event_id", "state")


@query("daemon_sessions", f"""{WITH}, q AS (SELECT ts, CASE WHEN ts <= lag(ts) OVER (ORDER BY ts) + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM ev),
g AS (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM q) SELECT min(ts) AS started, count(*) AS n FROM g GROUP BY g""")
def daemon_sessions(spark, d):
    """Runs of requests of all projects, as one process serves them."""
    s = S.sessions(hook_events(spark, d).select("ts"), "20 minutes")
    return s.select(F.col("start").cast("timestamp_ntz").alias("started"), "n")


@query("guard_scan", f"""{WITH}, {_GUARD}, files AS (SELECT event_id, project AS repo, path, content, sha256(content) AS hash FROM ev),
v AS (SELECT event_id, repo, path, ts_rank, text FROM (SELECT f.event_id, f.repo, f.path, f.content AS text, f.event_id AS ts_rank FROM files f ANTI JOIN guard g ON f.repo = g.repo AND f.path = g.path AND f.hash = g.hash)),
w AS (SELECT repo, event_id, path, {SQL_VERDICT} AS verdict FROM v)
SELECT repo, event_id, path, verdict FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY event_id) AS r FROM w WHERE verdict <> 'clean') WHERE r = 1""")
def guard_scan(spark, d):
    """The first file of each project that needs a question: not reviewed yet, and not clean."""
    from ..operators.scan import verdict

    ev = hook_events(spark, d).select("event_id", F.col("project").alias("repo"), "path", "content", F.sha2("content", 256).alias("hash"))
    seen = ev.where("event_id % 3 = 0")
    v = S.unreviewed(ev, seen).withColumn("verdict", verdict(F.col("content"))).where("verdict <> 'clean'")
    return v.groupBy("repo").agg(F.min(F.struct("event_id", "path", "verdict")).alias("first")).select("repo", "first.event_id", "first.path", "first.verdict")


@query("repo_history", f"{CMDS}, s AS (SELECT *, CASE command WHEN 'ignore' THEN 'ignored' WHEN 'monitor' THEN 'monitored' ELSE 'unknown' END AS state FROM cmds) SELECT event_id, state, coalesce(lag(state) OVER (PARTITION BY repo ORDER BY ts, event_id), 'unknown') AS before FROM s")
def repo_history(spark, d):
    """Every command on a project with the state before and after."""
    return S.replay(cmds(spark, d)).select("event_id", "before", "state")
