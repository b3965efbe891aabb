"""Audit of projects: inventory of their configuration files, state hash, checks, cache, reports and the flow around them.

Files are rows (repo, path, text); a null text is a file that can't be read. ``path`` is relative to the project. The configuration
folder holds commands, agents, memory and hooks (one level each) and two settings files. Everything is one row a file until the
checks' warnings are counted or printed a project; contents are hashed a file before they meet, so no task holds a project's texts at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogs as C
from . import commands as K
from .scan import CLEAN, INJECTION, SECRET, verdict
from .state import IGNORED, MONITORED, UNKNOWN

FOLDER = ".assistant"
#: Kinds of files in the order in which they are hashed and checked.
KINDS = ["commands", "agents", "memory", "settings", "hooks"]
SETTINGS = ["settings.json", "settings.local.json"]


def inventory(files: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(repo, kind, name, path, text) of the files that an audit reads: agents only with the extension md, unreadable ones left out."""
    base = rf"^{folder}/".replace(".", r"\.")
    deep = F.regexp_extract("path", base + r"(commands|agents|memory|hooks)/[^/]+$", 1)
    flat = F.regexp_extract("path", base + "(" + "|".join(s.replace(".", r"\.") for s in SETTINGS) + ")$", 1)
    kind = F.when(deep != "", deep).when(flat != "", "settings")
    out = files.withColumn("kind", kind).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return out.where("kind IS NOT NULL AND text IS NOT NULL AND (kind <> 'agents' OR name LIKE '%.md')").select("repo", "kind", "name", "path", "text")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def state_hash(found: DataFrame) -> DataFrame:
    """(repo, hash) over kinds, names and contents in order; any change of a file, its name or its kind changes it."""
    each = found.select("repo", _rank(F.col("kind")).alias("rank"), "kind", "name", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "name", "kind", "h")))
    line = F.transform(rows, lambda r: F.concat_ws("\u0001", r["kind"], r["name"], r["h"]))
    return each.groupBy("repo").agg(F.sha2(F.array_join(line, "\u0002").cast("binary"), 256).alias("hash"))


def is_code(name: Column) -> Column:
    """By extension, in lower case as given."""
    return F.regexp_extract(name, r"[^.]\.([^.]+)$", 1).isin(C.CODE_EXTENSIONS)


def check_text(found: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Warnings on commands, agents and memory. Code is scanned without the model and for data leaving the machine.

    ``score``: (key, text) -> (key, hit), the model; it sees what is clean and no code.
    """
    files = found.where(F.col("kind").isin("commands", "agents", "memory") & (F.col("text") != "")).withColumn("code", is_code(F.col("name")))
    files = files.withColumn("verdict", verdict(F.col("text")))
    if score is not None:
        key = F.struct("repo", "path")
        hits = score(files.where((F.col("verdict") == CLEAN) & ~F.col("code")).select(key.alias("key"), "text"))
        hits = hits.select(F.col("key.repo").alias("repo"), F.col("key.path").alias("path"), "hit")
        files = files.join(hits, ["repo", "path"], "left").withColumn("verdict", F.when(F.col("hit"), INJECTION).otherwise(F.col("verdict"))).drop("hit")
    bad = files.where(F.col("verdict").isin(INJECTION, SECRET))
    category = F.when(F.col("verdict") == INJECTION, "INJECTION").otherwise("SECRET")
    what = F.when(F.col("verdict") == INJECTION, " may contain prompt injection").otherwise(" may contain embedded secrets")
    scanned = bad.select("repo", "kind", "path", F.lit(0).alias("part"), category.alias("category"), F.concat("path", what).alias("message"), F.lit(None).cast("string").alias("reason"))
    leaks = files.where("code").withColumn("reason", K.exfiltration_udf("text")).where("reason IS NOT NULL")
    return scanned.unionByName(leaks.select("repo", "kind", "path", F.lit(1).alias("part"), F.lit("EXFIL").alias("category"), F.concat("path", F.lit(" contains exfiltration pattern")).alias("message"), "reason"))


def check_hooks(found: DataFrame, folder: str = FOLDER) -> DataFrame:
    """A warning that names all hook files of a project, and one for each with an injection (secrets don't count here) or data leaving the machine."""
    hooks = found.where("kind = 'hooks'")
    names = F.array_join(F.array_sort(F.collect_list("name")), ", ")
    listed = hooks.groupBy("repo").agg(F.concat(F.lit(f"{folder}/hooks/ contains executable scripts: "), names).alias("message"))
    row = lambda df, path, part, reason: df.select("repo", F.lit("hooks").alias("kind"), path.alias("path"), F.lit(part).alias("part"), F.lit("HOOKS").alias("category"), "message", reason.alias("reason"))
    none = F.lit(None).cast("string")
    bad = hooks.where(verdict(F.col("text")) == INJECTION).withColumn("message", F.concat("path", F.lit(" contains injection pattern")))
    leaks = hooks.withColumn("reason", K.exfiltration_udf("text")).where("reason IS NOT NULL").withColumn("message", F.concat("path", F.lit(" contains exfiltration pattern")))
    return row(listed, F.lit(""), 0, none).unionByName(row(bad, F.col("path"), 1, none)).unionByName(row(leaks, F.col("path"), 2, F.col("reason")))


def check_permissions(found: DataFrame) -> DataFrame:
    """Warnings on settings: shell rules that are allowed beforehand, and allow rules without any deny rule. Text that is no JSON is skipped."""
    v = F.try_parse_json("text")
    allow = F.try_variant_get(v, "$.permissions.allow", "array<variant>")
    deny = F.try_variant_get(v, "$.permissions.deny", "array<variant>")
    s = found.where("kind = 'settings'").withColumn("allow", allow).withColumn("deny", deny).where(F.size("allow") > 0)
    strings = F.transform("allow", lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    shell = F.filter(strings, lambda x: F.coalesce(x.startswith("Bash("), F.lit(False)))
    row = lambda df, part, message: df.select("repo", "kind", "path", F.lit(part).alias("part"), F.lit("PERMISSIONS").alias("category"), message.alias("message"), F.lit(None).cast("string").alias("reason"))
    named = row(s.withColumn("shell", shell).where(F.size("shell") > 0), 0, F.concat("path", F.lit(" pre-approves Bash commands: "), F.array_join("shell", ", ")))
    open_ = row(s.where(F.coalesce(F.size("deny"), F.lit(0)) <= 0), 1, F.concat("path", F.lit(" has "), F.size("allow").cast("string"), F.lit(" allow rule(s) with no deny rules")))
    return named.unionByName(open_)


def audit(files: DataFrame, cache: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None, folder: str = FOLDER) -> DataFrame:
    """(repo, no, category, path, message, reason): all warnings in the order of the checks, for projects whose state hash is not in ``cache`` (repo, hash).

    After an audit the states are marked with ``mark``, warnings or not, so that each state warns once.
    """
    found = inventory(files, folder)
    if cache is not None:
        known = state_hash(found).join(cache.select("repo", "hash").distinct(), ["repo", "hash"], "left_semi")
        found = found.join(known.select("repo"), "repo", "left_anti")
    rows = check_text(found, score).unionByName(check_hooks(found, folder)).unionByName(check_permissions(found))
    # hooks come before settings here, whatever the order in which they are hashed
    rank = F.when(F.col("kind") == "settings", 9).otherwise(_rank(F.col("kind")))
    order = Window.partitionBy("repo").orderBy(rank, F.when(F.col("kind") == "hooks", F.least("part", F.lit(1))).otherwise(0), "path", "part")
    return rows.withColumn("no", F.row_number().over(order)).select("repo", "no", "category", "path", "message", "reason")


def mark(cache: DataFrame, files: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The cache (repo, hash) with the present state of these projects in place of an older one."""
    now = state_hash(inventory(files, folder))
    return cache.select("repo", "hash").join(now.select("repo"), "repo", "left_anti").unionByName(now)


def _text(row: Column) -> Column:
    return F.concat(row["message"], F.coalesce(F.concat(F.lit(": "), row["reason"]), F.lit("")))


def report(warnings: DataFrame) -> DataFrame:
    """(repo, total, text): the warnings of each project as Markdown."""
    rows = F.array_sort(F.collect_list(F.struct("no", "category", "message", "reason")))
    lines = F.transform("rows", lambda r: F.concat(F.lit("\n> **"), r["category"], F.lit("**: "), _text(r), F.lit("\n")))
    return warnings.groupBy("repo").agg(rows.alias("rows")).select("repo", F.size("rows").alias("total"), F.concat(F.lit("## Project Security Scan\n"), F.array_join(lines, "")).alias("text"))


def opt_in(projects: DataFrame, warnings: DataFrame, command: str) -> DataFrame:
    """(repo, total, text): the question on a project that is seen for the first time; of more than 3 findings the first 2 are shown.

    ``projects``: (repo, error); error is true where the model could not be asked.
    """
    rows = F.slice(F.array_sort(F.collect_list(F.struct("no", "category", "message", "reason"))), 1, 3)
    got = projects.join(warnings.groupBy("repo").agg(F.count(F.lit(1)).cast("int").alias("total"), rows.alias("rows")), "repo", "left")
    got = got.withColumn("total", F.coalesce("total", F.lit(0)))
    shown = F.transform(F.when(F.col("total") > 3, F.slice("rows", 1, 2)).otherwise(F.col("rows")), lambda r: F.concat(F.lit("- "), r["category"], F.lit(": "), _text(r), F.lit("\n")))
    title = F.when(F.col("total") > 3, F.concat(F.lit("\nFindings (showing first 2 of "), F.col("total").cast("string"), F.lit("):\n"))).otherwise("\nFindings:\n")
    found = F.when(F.col("total") > 0, F.concat(title, F.array_join(shown, ""))).otherwise("")
    partial = F.when(F.col("error") & (F.col("total") == 0), "\nNote: the model was not available, so these are partial results.\n").otherwise("")
    first = F.concat(F.lit("First scan of "), F.col("repo").cast("string"), F.when((F.col("total") == 0) & ~F.col("error"), ": no issues found.\n").otherwise(".\n"))
    help_ = F.when(F.col("total") > 0, ", then tell them about the findings and offer to fix them.").otherwise(".")
    ask = F.concat(F.lit(f"\nAsk the user whether to scan this project.\n- If yes: run `{command} monitor`"), help_, F.lit(f"\n- If no: run `{command} ignore`.\n"))
    return got.select("repo", "total", F.concat(first, found, partial, ask).alias("text"))


def flow(projects: DataFrame, files: DataFrame, cache: DataFrame, command: str, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(repo, state, kind, exit_code, total, text): what a prompt in each project leads to.

    ``projects``: (repo, state, ask, error): ask is whether new projects are asked about, error whether the model failed. An ignored project is
    left alone; a new one becomes monitored, or is asked about without the cache and without failing; a model error elsewhere is a failure; states
    in the cache and projects without warnings print nothing.
    """
    p = projects.withColumn("new_ask", (F.col("state") == UNKNOWN) & F.col("ask"))
    live = p.where(F.col("state") != IGNORED)
    fresh = audit(files.join(live.where("new_ask AND NOT error").select("repo"), "repo", "left_semi"), None, score)
    again = audit(files.join(live.where("NOT new_ask AND NOT error").select("repo"), "repo", "left_semi"), cache, score)
    asked = opt_in(live.where("new_ask").select("repo", "error"), fresh, command).select("repo", "total", "text", F.lit("opt_in").alias("kind"))
    told = report(again).select("repo", "total", "text", F.lit("warnings").alias("kind"))
    out = p.join(asked.unionByName(told), "repo", "left")
    failed = (F.col("state") != IGNORED) & ~F.col("new_ask") & F.col("error")
    state = F.when((F.col("state") == UNKNOWN) & ~F.col("ask"), MONITORED).otherwise(F.col("state"))
    return out.select(
        "repo", state.alias("state"), F.when(failed, "failure").otherwise(F.coalesce("kind", F.lit("none"))).alias("kind"), F.when(failed, 1).otherwise(0).alias("exit_code"),
        F.coalesce("total", F.lit(0)).alias("total"), F.when(failed, "Project audit failed: the model is not available.").otherwise(F.col("text")).alias("text"))
