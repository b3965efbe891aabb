"""Queries of the project audit over planted project files, of binary frames, and of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames
from ..operators import audit as A
from ..operators import ml
from ..sources.files import changed, diff_report
from ..sources.planting import EVENTS_SQL, hook_events, quoted
from . import commands as PC
from .text import SQL_VERDICT, _stub_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Settings by event_id, and the two warnings' texts behind the path.
SETTINGS = ['{"permissions":{"allow":["Bash(ls)","Read(x)","Bash(git:*)",7]}}', '{"permissions":{"allow":["Read(x)"],"deny":["Bash(rm)"]}}', "{broken", '{"permissions":{"allow":[]}}', '{"permissions":{"allow":["Read(y)"],"deny":[]}}']
_SHELL = [" pre-approves Bash commands: Bash(ls), Bash(git:*)", None, None, None, None]
_OPEN = [" has 4 allow rule(s) with no deny rules", None, None, None, " has 1 allow rule(s) with no deny rules"]


def _by(values: list, key: str = "(event_id // 8)") -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else quoted(v)}" for i, v in enumerate(values)) + " END"


#: Eight files a project: (path below the folder, kind or null where an audit leaves the file out, what it holds).
FILES = [
    ("commands/a.md", "commands", "content"), ("commands/run.sh", "commands", "command"), ("agents/b.md", "agents", "content"), ("agents/notes.txt", None, "content"),
    ("memory/c.md", "memory", "content"), ("settings.json", "settings", "settings"), ("hooks/h.sh", "hooks", "command"), ("commands/deep/d.md", None, "content"),
]
_PATHS = [f"{A.FOLDER}/{p}" for p, _, _ in FILES]
_FILES_SQL = f"""WITH ev AS ({EVENTS_SQL}), files AS (SELECT event_id, event_id // 8 AS repo, {_by(_PATHS, 'event_id')} AS path, {_by([k for _, k, _ in FILES], 'event_id')} AS kind,
{_by([p.split('/')[-1] for p, _, _ in FILES], 'event_id')} AS name, CASE {_by([h for _, _, h in FILES], 'event_id')} WHEN 'content' THEN content WHEN 'command' THEN command ELSE {_by(SETTINGS)} END AS text FROM ev), inv AS (SELECT * FROM files WHERE kind IS NOT NULL)"""


def project_files(spark, d):
    e = hook_events(spark, d)
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), F.expr(f"int({key} % {len(values)} + 1)"))
    holds = pick([h for _, _, h in FILES], "event_id")
    text = F.when(holds == "content", F.col("content")).when(holds == "command", F.col("command")).otherwise(pick(SETTINGS, "(event_id div 8)"))
    return e.select(F.expr("event_id div 8").alias("repo"), pick(_PATHS, "event_id").alias("path"), text.alias("text"))


@query("audit_inventory", f"{_FILES_SQL} SELECT repo, kind, name, strlen(text) AS n_bytes FROM inv")
def audit_inventory(spark, d):
    return A.inventory(project_files(spark, d)).select("repo", "kind", "name", F.octet_length("text").cast("long").alias("n_bytes"))


_HASH = f"hashed AS (SELECT repo, sha256(string_agg(concat_ws(chr(1), kind, name, sha256(text)), chr(2) ORDER BY list_position({A.KINDS!r}, kind), name)) AS hash FROM inv GROUP BY repo)"


@query("state_hash", f"{_FILES_SQL}, {_HASH} SELECT repo, hash FROM hashed")
def state_hash(spark, d):
    return A.state_hash(A.inventory(project_files(spark, d)))


_EXFIL = PC.listed(*PC.EXFIL_HITS).replace("command IN", "text IN")
_MODEL = f"({_stub_sql(0.2)} >= 0.5 OR {_stub_sql(0.4)} >= 0.75)".replace("chunk", "text")
_V = f"v AS (SELECT *, CASE WHEN kind = 'hooks' OR NOT regexp_matches(name, '\\.sh$') AND ({SQL_VERDICT}) = 'clean' AND {_MODEL} THEN CASE WHEN kind = 'hooks' THEN {SQL_VERDICT} ELSE 'injection' END ELSE {SQL_VERDICT} END AS verdict FROM inv)"
_WARNINGS = f"""{_V}, w AS (
SELECT repo, 10 * list_position({A.KINDS!r}, kind) AS ord, path, 0 AS part, CASE verdict WHEN 'injection' THEN 'INJECTION' ELSE 'SECRET' END AS category, path || CASE verdict WHEN 'injection' THEN ' may contain prompt injection' ELSE ' may contain embedded secrets' END AS message FROM v WHERE kind IN ('commands', 'agents', 'memory') AND text <> '' AND verdict <> 'clean'
UNION ALL SELECT repo, 10 * list_position({A.KINDS!r}, kind), path, 1, 'EXFIL', path || ' contains exfiltration pattern' FROM v WHERE kind = 'commands' AND name = 'run.sh' AND {_EXFIL}
UNION ALL SELECT repo, 60, '', 0, 'HOOKS', '{A.FOLDER}/hooks/ contains executable scripts: ' || string_agg(name, ', ' ORDER BY name) FROM v WHERE kind = 'hooks' GROUP BY repo
UNION ALL SELECT repo, 61, path, 1, 'HOOKS', path || ' contains injection pattern' FROM v WHERE kind = 'hooks' AND verdict = 'injection'
UNION ALL SELECT repo, 61, path, 2, 'HOOKS', path || ' contains exfiltration pattern' FROM v WHERE kind = 'hooks' AND {_EXFIL}
UNION ALL SELECT repo, 70, path, 0, 'PERMISSIONS', path || {_by(_SHELL)} FROM v WHERE kind = 'settings' AND {_by(_SHELL)} IS NOT NULL
UNION ALL SELECT repo, 70, path, 1, 'PERMISSIONS', path || {_by(_OPEN)} FROM v WHERE kind = 'settings' AND {_by(_OPEN)} IS NOT NULL),
cached AS (SELECT repo FROM inv GROUP BY repo HAVING repo % 3 = 0)"""
_NUMBERED = "SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY ord, path, part))::INT AS no, category, path, message FROM w"


def _model(df):
    return ml.ensemble(ml.score_chunks(df, "key", ml.STUBS), "key", 0.5)


def _cache(spark, d):
    """The state of one project in three, and a stale one of the others."""
    h = A.state_hash(A.inventory(project_files(spark, d)))
    return h.select("repo", F.when(F.col("repo") % 3 == 0, F.col("hash")).otherwise("stale").alias("hash"))


@query("audit", f"{_FILES_SQL}, {_WARNINGS} SELECT * FROM ({_NUMBERED}) WHERE repo NOT IN (SELECT repo FROM cached)")
def audit(spark, d):
    """Warnings of the projects whose state is not in the cache."""
    return A.audit(project_files(spark, d), _cache(spark, d), _model).drop("reason")


@query("audit_hooks", f"{_FILES_SQL}, {_WARNINGS} SELECT repo, message FROM w WHERE category = 'HOOKS'")
def audit_hooks(spark, d):
    return A.check_hooks(A.inventory(project_files(spark, d))).select("repo", "message")


_REPORT = "r AS (SELECT repo, count(*)::INT AS total, '## Project Security Scan' || chr(10) || string_agg(chr(10) || '> **' || category || '**: ' || message || chr(10), '' ORDER BY no) AS text FROM n GROUP BY repo)"


@query("audit_report", f"{_FILES_SQL}, {_WARNINGS}, n AS ({_NUMBERED}), {_REPORT} SELECT repo, total, text FROM r")
def audit_report(spark, d):
    """The warnings of each project as Markdown; reasons are left out here, as the SQL has none."""
    w = A.audit(project_files(spark, d), None, _model).withColumn("reason", F.lit(None).cast("string"))
    return A.report(w)


_PROJECTS = "p AS (SELECT DISTINCT repo, CASE repo % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'ignored' ELSE 'monitored' END AS state, repo % 8 >= 4 AS ask, repo % 5 = 0 AS error FROM inv)"
_KIND = "CASE WHEN state = 'ignored' THEN 'none' WHEN state = 'unknown' AND ask THEN 'opt_in' WHEN error THEN 'failure' WHEN total > 0 AND p.repo NOT IN (SELECT repo FROM cached) THEN 'warnings' ELSE 'none' END"


@query("audit_flow", f"""{_FILES_SQL}, {_WARNINGS}, {_PROJECTS}, t AS (SELECT repo, count(*)::INT AS total FROM w GROUP BY repo), f AS (SELECT p.*, total, {_KIND} AS kind FROM p LEFT JOIN t USING (repo))
SELECT repo, CASE WHEN state = 'unknown' AND NOT ask THEN 'monitored' ELSE state END AS state, kind, CASE WHEN kind = 'failure' THEN 1 ELSE 0 END AS exit_code, CASE WHEN kind = 'warnings' OR kind = 'opt_in' AND NOT error THEN total ELSE 0 END AS total FROM f""")
def audit_flow(spark, d):
    """What a prompt leads to in each project: ask, warn, fail or nothing."""
    files = project_files(spark, d)
    p = files.select("repo").distinct().select("repo", F.expr("CASE repo % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'ignored' ELSE 'monitored' END").alias("state"), F.expr("repo % 8 >= 4").alias("ask"), F.expr("repo % 5 = 0").alias("error"))
    return A.flow(p, files, _cache(spark, d), "guard", _model).drop("text")


@query("opt_in_message")
def opt_in_message(spark, d):
    """The whole text of the question on new projects; a test states it."""
    files = project_files(spark, d)
    p = files.select("repo").distinct().withColumn("error", F.expr("repo % 5 = 0"))
    return A.opt_in(p, A.audit(files, None, _model), "guard")


#: Frames by doc_id: cut in the header, unknown kind, too long, cut in the text, broken text, a ping, and whole ones.
_FRAME = "CASE doc_id % 8 WHEN 0 THEN 'partial' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'partial' WHEN 4 THEN 'error' ELSE 'ok' END"


@query("frame_decode", f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_FRAME} AS status FROM documents)
SELECT doc_id, status, CASE WHEN status = 'ok' THEN CASE WHEN doc_id % 8 = 5 THEN 'ping' ELSE 'full' END END AS kind, CASE WHEN status = 'ok' THEN 0.75::FLOAT END AS threshold, CASE WHEN status = 'ok' THEN sha256(text) END AS hash FROM t""")
def frame_decode(spark, d):
    """Requests around whole documents, decoded."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = frames.encode(F.when(F.col("doc_id") % 8 == 5, 2).when(F.col("doc_id") % 8 == 1, 9).otherwise(0), F.lit("0000403F"), F.concat("text", F.when(F.col("doc_id") % 8 == 3, "x").otherwise("")))
    i = F.col("doc_id") % 8
    frame = (
        F.when(i == 0, F.substring(whole, F.lit(1), F.lit(8))).when(i == 2, F.unhex(F.concat(F.lit("000000403F01000001"), F.hex(F.encode("text", "UTF-8")))))
        .when(i == 3, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).when(i == 4, F.unhex(F.lit("000000403F02000000C328"))).otherwise(whole)
    )
    f = t.select("doc_id", frames.decode(frame).alias("f"))
    return f.select("doc_id", "f.status", "f.kind", "f.threshold", F.sha2(F.col("f.text").cast("binary"), 256).alias("hash"))


_OLD = "old AS (SELECT repo, path, CASE WHEN repo % 2 = 0 THEN text ELSE text || ' ' END AS text FROM files WHERE event_id % 8 <> 4)"
_CHANGED = f"ch AS (SELECT f.repo || '/' || f.path AS path, f.text FROM files f WHERE regexp_matches(f.path, '(?i)\\.(md|sh)$') AND NOT EXISTS (SELECT 1 FROM old o WHERE o.repo = f.repo AND o.path = f.path AND o.text = f.text))"


@query("snapshot_diff", f"{_FILES_SQL}, {_OLD}, {_CHANGED} SELECT path, {SQL_VERDICT} AS verdict FROM ch")
def snapshot_diff(spark, d):
    """Files with two extensions that are new or changed since an older snapshot, scanned."""
    return _scanned(spark, d)


def _scanned(spark, d):
    from ..operators.scan import verdict

    new = project_files(spark, d)
    old = new.where(f"path <> '{_PATHS[4]}'").withColumn("text", F.expr("CASE WHEN repo % 2 = 0 THEN text ELSE text || ' ' END"))
    c = changed(old, new, ["MD", " sh"])
    return c.select(F.concat_ws("/", F.col("repo").cast("string"), "path").alias("path"), verdict(F.col("text")).alias("verdict"))


@query("snapshot_report", f"{_FILES_SQL}, {_OLD}, {_CHANGED}, v AS (SELECT path, {SQL_VERDICT} AS verdict FROM ch) SELECT count(*) AS scanned, count(*) FILTER (verdict <> 'clean') AS detected, CASE WHEN count(*) FILTER (verdict <> 'clean') > 0 THEN 1 ELSE 0 END AS exit_code FROM v")
def snapshot_report(spark, d):
    return diff_report(_scanned(spark, d)).drop("files")
