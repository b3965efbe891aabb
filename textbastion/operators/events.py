"""Routing of tool-call events: what to read of an event, and the decision with the first rule that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.settings import Lists
from . import commands as K
from .guard import asked
from .scan import verdict
from .state import IGNORED, MONITORED, UNKNOWN

#: Strings of plug-in tools are scanned from this many bytes on.
LEAST_BYTES = 10
SCHEMA = "event_id bigint, tool_name string, tool_input variant, tool_response variant, session_id string, hook_event_name string, cwd string, _corrupt_record string"


def response_text(v: Column) -> Column:
    """Text of a variant: null for absent, null and empty; strings as they are; other values as compact JSON."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))).when(kind == "VOID", None).otherwise(F.to_json(v))


def route(hook_event_name: Column) -> Column:
    """Anything but a prompt or a response, also a missing name, is a tool call."""
    return F.when(hook_event_name == "UserPromptSubmit", "audit").when(hook_event_name == "PostToolUse", "post").otherwise("pre")


def gate(state: Column, tainted: Column) -> Column:
    """allow, deny, or null where the rules decide."""
    return F.when(state == IGNORED, "allow").when(tainted, "deny").when(state == UNKNOWN, "allow")


def scannable(tool: Column, content: Column, command: Column) -> Column:
    """The text of a call that is scanned for injection."""
    plugin = tool.startswith("mcp__") & (F.octet_length(content) >= LEAST_BYTES)
    return F.when(tool.isin("Write", "Edit", "NotebookEdit") | plugin, content).when(tool == "Bash", command)


def working_directory(cwd: Column, default: str) -> Column:
    """The directory of a call, or the process's where it names none."""
    return F.coalesce(F.nullif(cwd, F.lit("")), F.lit(default))


def decide(events: DataFrame, cwd: str, home: str, asks: DataFrame | None = None, lists: Lists = Lists()) -> DataFrame:
    """Adds ``decision`` (deny, ask or null), ``rule`` and ``exit_code`` to tool calls with tool_name, command, path, content, state and tainted.

    Order: gate, instruction files (``asks`` of ``guard.questions``), data leaving by a shell command, destructive command or protected path, sensitive path, content. Commands of rows
    that the gate decides are null for the parsers in Python. ``lists`` are the catalogs with a user's changes.
    """
    tool, path = F.col("tool_name"), F.col("path")
    e = events.withColumn("__gate", gate(F.col("state"), F.col("tainted")))
    if asks is not None:
        reached = asked(e.where("__gate IS NULL").select("project", "ts", "event_id"), asks).where("guard_path IS NOT NULL")
        e = e.join(reached.select("event_id", F.lit("instructions").alias("__guard")), "event_id", "left").withColumn("__gate", F.coalesce("__gate", "__guard")).drop("__guard")
    cmd = F.when((tool == "Bash") & F.col("__gate").isNull(), F.col("command"))
    e = e.withColumn("__exfil", K.exfiltration_column(cmd, lists)).withColumn("__destroys", K.destructive_column(cmd, F.lit(cwd), F.lit(home), lists.destructive_add, lists.destructive_remove))
    guarded = tool.isin("Write", "Edit", "NotebookEdit") & P.protected(path, F.lit(cwd), F.lit(home)).isNotNull()
    private = tool.isin("Read", "Write", "Edit", "Glob", "Grep") & P.has_sensitive_path(path, segments=list(lists.segments))
    # only rows that no earlier rule decides are scanned
    sofar = (
        F.when(F.col("__gate") == "deny", "taint").when(F.col("__gate") == "allow", "none").when(F.col("__gate") == "instructions", "instructions").when(F.col("__exfil").isNotNull(), "exfil")
        .when(F.col("__destroys").isNotNull(), "destructive").when(guarded, "protected_path").when(private, "sensitive_path")
    )
    e = e.withColumn("__rule", sofar)
    found = verdict(F.when(F.col("__rule").isNull(), scannable(tool, F.col("content"), F.col("command")))) == "injection"
    out = e.withColumn("rule", F.coalesce(F.nullif("__rule", F.lit("none")), F.when(F.col("__rule").isNull() & found, "injection"))).drop("__gate", "__exfil", "__destroys", "__rule")
    decision = F.when(F.col("rule").isin("taint", "exfil"), "deny").when(F.col("rule").isNotNull(), "ask")
    return out.withColumn("decision", decision).withColumn("exit_code", F.when(F.col("decision") == "deny", 2).otherwise(0))


def output_json(decision: Column, reason: Column) -> Column:
    """What an asking decision prints; others print nothing."""
    body = F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("ask").alias("permissionDecision"), reason.alias("permissionDecisionReason"))
    return F.when(decision == "ask", F.to_json(F.struct(body.alias("hookSpecificOutput"))))


def post(events: DataFrame, response: str) -> DataFrame:
    """Adds ``warning`` (injection, secret or null) to responses of monitored projects."""
    v = verdict(F.when(F.col("state") == MONITORED, F.col(response)))
    return events.withColumn("warning", F.when((F.col("state") == MONITORED) & v.isin("injection", "secret"), v))
