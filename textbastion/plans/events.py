"""Queries on tool-call events: parsing, routing, decisions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import state as S
from ..operators import guard as G
from ..sources.planting import CONTENTS, CWD, EVENTS_SQL, HOME, hook_events, quoted
from ..functions import paths as P
from . import commands as PC
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
_STATE = "CASE project % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'ignored' ELSE 'monitored' END"
_TAINTS = "(hook_event_name = 'PostToolUse' AND contains(lower(content), 'ignore all'))"
_ST = f"st AS (SELECT *, {_STATE} AS state, coalesce(max({_TAINTS}::INT) OVER (PARTITION BY project ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS tainted FROM ev)"


def staged(spark, d, taints: str = _TAINTS):
    return S.taint_replay(hook_events(spark, d).withColumn("state", F.expr(_STATE)), F.expr(taints))


#: Payloads as JSON by event_id.
_JSONS = ['{"a": "first text value", "b": [{"c": "nested value"}, 1, null, "x"]}', '"plain"', '""', "null", '[1, "two", {"k": "three"}]', "not json", '{"k": 1.5}']
_TEXTS = ['{"a":"first text value","b":[{"c":"nested value"},1,null,"x"]}', "plain", None, None, '[1,"two",{"k":"three"}]', None, '{"k":1.5}']
_STRINGS = ["first text value|nested value|x", "plain", "", "", "three|two", None, ""]


def _case(values: list) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else quoted(v)}" for i, v in enumerate(values)) + " END"


def _case_of(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def _payloads(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    return e.withColumn("raw", F.element_at(F.array(*map(F.lit, _JSONS)), (F.col("event_id") % len(_JSONS) + 1).cast("int")))


@query("hook_parse", f"SELECT CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def hook_parse(spark, d):
    """Events as JSON lines; a line that is no JSON is an error, never dropped."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    line = F.when(F.col("event_id") % 3 == 1, "{broken").otherwise(F.to_json(F.struct("event_id", F.lit("Bash").alias("tool_name"))))
    parsed = e.select(F.from_json(line, E.SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("h"))
    return parsed.select(F.when(F.col("h._corrupt_record").isNotNull(), "error").otherwise("ok").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("response_text", f"SELECT event_id, {_case(_TEXTS)} AS text FROM events")
def response_text(spark, d):
    return _payloads(spark, d).select("event_id", E.response_text(F.try_parse_json("raw")).alias("text"))


@query("route_events", f"{WITH} SELECT event_id, CASE hook_event_name WHEN 'UserPromptSubmit' THEN 'audit' WHEN 'PostToolUse' THEN 'post' ELSE 'pre' END AS route FROM ev")
def route_events(spark, d):
    return hook_events(spark, d).select("event_id", E.route(F.col("hook_event_name")).alias("route"))


@query("gate", f"{WITH}, {_ST} SELECT event_id, CASE WHEN state = 'ignored' THEN 'allow' WHEN tainted THEN 'deny' WHEN state = 'unknown' THEN 'allow' END AS gate FROM st")
def gate(spark, d):
    return staged(spark, d).select("event_id", E.gate(F.col("state"), F.col("tainted")).alias("gate"))


_SCAN = "CASE WHEN tool_name IN ('Write', 'Edit', 'NotebookEdit') OR (starts_with(tool_name, 'mcp__') AND strlen(content) >= 10) THEN content WHEN tool_name = 'Bash' THEN command END"


@query("scannable_content", f"{WITH} SELECT event_id, {_SCAN} AS text FROM ev")
def scannable_content(spark, d):
    return hook_events(spark, d).select("event_id", E.scannable(F.col("tool_name"), F.col("content"), F.col("command")).alias("text"))


_PRIVATE = f"(tool_name IN ('Read', 'Write', 'Edit', 'Glob', 'Grep') AND regexp_matches(lower(path), {quoted(P.sensitive_regex(P.EDGE_ASCII))}))"


@query("tool_sensitive_path", f"{WITH} SELECT event_id, {_PRIVATE} AS hit FROM ev")
def tool_sensitive_path(spark, d):
    hit = F.col("tool_name").isin("Read", "Write", "Edit", "Glob", "Grep") & P.has_sensitive_path(F.col("path"))
    return hook_events(spark, d).select("event_id", hit.alias("hit"))


_DECIDED = f"""{WITH}, {_ST}, full_paths AS (SELECT *, {PC._CLEAN} AS f, {_SCAN} AS text FROM st), ruled AS (SELECT event_id, CASE WHEN state = 'ignored' THEN NULL WHEN tainted THEN 'taint' WHEN state = 'unknown' THEN NULL
WHEN tool_name = 'Bash' AND {PC.listed(*PC.EXFIL_HITS)} THEN 'exfil' WHEN tool_name = 'Bash' AND {PC.listed(*PC.DESTRUCTIVE_HITS)} THEN 'destructive'
WHEN tool_name IN ('Write', 'Edit', 'NotebookEdit') AND ({PC.PROTECTED_SQL}) IS NOT NULL THEN 'protected_path' WHEN {_PRIVATE} THEN 'sensitive_path' WHEN {SQL_VERDICT} = 'injection' THEN 'injection' END AS rule
FROM full_paths WHERE hook_event_name NOT IN ('UserPromptSubmit', 'PostToolUse'))"""


@query("pre_tool_use", f"{_DECIDED} SELECT event_id, rule, CASE WHEN rule IN ('taint', 'exfil') THEN 'deny' WHEN rule IS NOT NULL THEN 'ask' END AS decision FROM ruled")
def pre_tool_use(spark, d):
    calls = staged(spark, d).where(E.route(F.col("hook_event_name")) == "pre")
    return E.decide(calls, CWD, HOME).select("event_id", "rule", "decision")


@query("hook_decisions", f"{_DECIDED} SELECT event_id, CASE WHEN rule IN ('taint', 'exfil') THEN 2 ELSE 0 END AS exit_code, CASE WHEN rule IS NOT NULL AND rule NOT IN ('taint', 'exfil') THEN '{{\"hookSpecificOutput\":{{\"hookEventName\":\"PreToolUse\",\"permissionDecision\":\"ask\",\"permissionDecisionReason\":\"' || rule || '\"}}}}' END AS output FROM ruled")
def hook_decisions(spark, d):
    """What each decision prints and its exit code."""
    calls = staged(spark, d).where(E.route(F.col("hook_event_name")) == "pre")
    return E.decide(calls, CWD, HOME).select("event_id", "exit_code", E.output_json(F.col("decision"), F.col("rule")).alias("output"))


#: Three instruction files above each project, the nearest first; the second of one project in seven can't be read.
_RANKS = 3
_GUARDED = f"""files AS (SELECT project AS repo, rank, 'up' || rank || '/INSTRUCTIONS.md' AS path, CASE WHEN project % 7 = 0 AND rank = 1 THEN NULL ELSE {_case_of('(project * 3 + rank)', CONTENTS)} END AS text
FROM (SELECT DISTINCT project FROM ev), (SELECT unnest(range({_RANKS})) AS rank)), fresh AS (SELECT * FROM files WHERE NOT (repo % 5 = 0 AND rank = 0 AND text IS NOT NULL)),
bad AS (SELECT repo, rank, path, text IS NULL AS again, CASE WHEN text IS NULL THEN 'unreadable' ELSE 'scan' END AS reason FROM fresh WHERE text IS NULL OR ({SQL_VERDICT}) <> 'clean'),
asks AS (SELECT * FROM (SELECT *, (row_number() OVER w)::INT AS n, coalesce(max(again::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blocked FROM bad WINDOW w AS (PARTITION BY repo ORDER BY rank)) WHERE blocked = 0)"""


def instruction_files(spark, d):
    p = hook_events(spark, d).select(F.col("project").alias("repo")).distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(_RANKS - 1))))
    text = F.element_at(F.array(*map(F.lit, CONTENTS)), F.expr(f"int((repo * 3 + rank) % {len(CONTENTS)} + 1)"))
    return p.select("repo", "rank", F.concat(F.lit("up"), F.col("rank").cast("string"), F.lit("/INSTRUCTIONS.md")).alias("path"), F.when(~F.expr("repo % 7 = 0 AND rank = 1"), text).alias("text"))


def instruction_questions(spark, d, score=None):
    """Which instruction files ask, where the nearest of one project in five has been reviewed."""
    files = instruction_files(spark, d)
    seen = files.where("repo % 5 = 0 AND rank = 0 AND text IS NOT NULL").select("repo", "path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return G.questions(files, seen, score)


@query("guard_questions", f"{WITH}, {_GUARDED} SELECT repo, n, path, reason, again FROM asks")
def guard_questions(spark, d):
    return instruction_questions(spark, d)


_GUARDED_RULED = f"""{_DECIDED}, {_GUARDED}, live AS (SELECT event_id, project, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) AS n FROM st WHERE hook_event_name NOT IN ('UserPromptSubmit', 'PostToolUse') AND NOT tainted AND state NOT IN ('ignored', 'unknown')),
hit AS (SELECT event_id FROM live JOIN asks ON repo = project AND (asks.n = live.n OR (asks.again AND live.n >= asks.n)))"""


@query("pre_tool_use_guarded", f"{_GUARDED_RULED} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM hit) THEN 'instructions' ELSE rule END AS rule FROM ruled")
def pre_tool_use_guarded(spark, d):
    """Decisions with instruction files: a project's first calls ask about the files that need a review."""
    calls = staged(spark, d).where(E.route(F.col("hook_event_name")) == "pre")
    return E.decide(calls, CWD, HOME, instruction_questions(spark, d)).select("event_id", "rule")


@query("post_tool_use", f"{WITH}, v AS (SELECT event_id, {_STATE} AS state, {SQL_VERDICT.replace('text', 'content')} AS verdict FROM ev WHERE hook_event_name = 'PostToolUse') SELECT event_id, CASE WHEN state = 'monitored' AND verdict <> 'clean' THEN verdict END AS warning FROM v")
def post_tool_use(spark, d):
    e = hook_events(spark, d).where("hook_event_name = 'PostToolUse'").withColumn("state", F.expr(_STATE))
    return E.post(e, "content").select("event_id", "warning")


@query("taint_events", f"{WITH} SELECT event_id, CASE WHEN path <> '' THEN 'file: ' || path ELSE 'command: ' || command END AS source FROM ev WHERE {_TAINTS}")
def taint_events(spark, d):
    """Where a tainting response came from."""
    source = F.coalesce(F.concat(F.lit("file: "), F.nullif("path", F.lit(""))), F.concat(F.lit("command: "), F.col("command")))
    return hook_events(spark, d).where(_TAINTS).select("event_id", source.alias("source"))


@query("audit_text", f"{WITH}, f AS (SELECT DISTINCT project, path, content AS text FROM ev), v AS (SELECT project, path, {SQL_VERDICT} AS verdict FROM f WHERE text <> '') SELECT project, CASE verdict WHEN 'injection' THEN 'INJECTION' ELSE 'SECRET' END AS category, count(*) AS n FROM v WHERE verdict <> 'clean' GROUP BY 1, 2")
def audit_text(spark, d):
    """Findings of each project's files by category."""
    from ..operators.scan import verdict

    files = hook_events(spark, d).select("project", "path", "content").where("content <> ''").distinct()
    v = files.select("project", verdict(F.col("content")).alias("verdict")).where("verdict <> 'clean'")
    return v.groupBy("project", F.when(F.col("verdict") == "injection", "INJECTION").otherwise("SECRET").alias("category")).agg(F.count(F.lit(1)).alias("n"))


_SETTINGS = ['{"permissions":{"allow":["Bash(ls)","Read(x)","Bash(git:*)"]}}', '{"permissions":{"allow":["Read(x)"],"deny":["Bash(rm)"]}}', "{broken", '{"permissions":{"allow":[]}}']
_RULES = ["Bash(ls), Bash(git:*)", None, None, None]
_NO_DENY = ["3 allow rule(s) with no deny rules", None, None, None]


@query("audit_permissions", f"SELECT event_id, {_case(_RULES)} AS bash_rules, {_case(_NO_DENY)} AS no_deny FROM events")
def audit_permissions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.element_at(F.array(*map(F.lit, _SETTINGS)), (F.col("event_id") % len(_SETTINGS) + 1).cast("int")).alias("raw"))
    p = e.select("event_id", F.from_json("raw", "permissions struct<allow:array<string>,deny:array<string>>").alias("s"))
    allow, deny = F.col("s.permissions.allow"), F.col("s.permissions.deny")
    shell = F.filter(allow, lambda x: x.startswith("Bash("))
    n = F.coalesce(F.size(allow), F.lit(0))
    open_ = (n > 0) & (F.coalesce(F.size(deny), F.lit(0)) <= 0)
    return p.select("event_id", F.when(F.size(shell) > 0, F.array_join(shell, ", ")).alias("bash_rules"), F.when(open_, F.concat(n.cast("string"), F.lit(" allow rule(s) with no deny rules"))).alias("no_deny"))


@query("diff_scan", f"{WITH}, f AS (SELECT event_id, content AS text FROM ev WHERE regexp_matches(path, '(?i)\\.(rs|py)$')) SELECT {SQL_VERDICT} AS verdict, count(*) AS n FROM f GROUP BY 1")
def diff_scan(spark, d):
    """Changed files with a chosen extension by verdict."""
    from ..operators.scan import verdict

    files = hook_events(spark, d).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("rs", "py"))
    return files.groupBy(verdict(F.col("content")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("json_strings", f"SELECT event_id, {_case(_STRINGS)} AS strings FROM events")
def json_strings(spark, d):
    """All string values of a JSON text at any depth, sorted; null where it does not parse."""
    from ..functions.jsons import string_values

    return _payloads(spark, d).select("event_id", F.array_join(F.array_sort(string_values(F.col("raw"))), "|").alias("strings"))
