"""Instruction files above a project's working directory: which of them ask for a review, and which tool calls ask about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import CLEAN, verdict

#: The model's threshold for texts that are instructions by nature, and the most files that lie above a directory here.
THRESHOLD, MOST = 0.9, 16


def questions(files: DataFrame, reviewed: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(repo, n, path, reason, again): the files (repo, rank, path, text) that ask, the nearest (least rank) first, n from 1.

    A file that can't be read (null text) asks each time, so nothing behind it is reached (``again``). Content in ``reviewed`` (repo, path, hash) is
    skipped; any finding of the scan asks, then the model (``score``: (key, text) -> (key, hit, failed) at ``THRESHOLD``), whose failure asks
    each time as well.
    """
    f = files.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    f = f.join(reviewed.select("repo", "path", "hash").distinct().withColumn("__seen", F.lit(True)), ["repo", "path", "hash"], "left").where("__seen IS NULL").drop("__seen")
    f = f.withColumn("verdict", verdict(F.col("text")))
    reason = F.when(F.col("text").isNull(), "unreadable").when(F.col("verdict") != CLEAN, "scan")
    if score is not None:
        got = score(f.where(F.col("text").isNotNull() & (F.col("verdict") == CLEAN)).select(F.struct("repo", "path").alias("key"), "text"))
        f = f.join(got.select(F.col("key.repo").alias("repo"), F.col("key.path").alias("path"), "hit", "failed"), ["repo", "path"], "left")
        reason = reason.when(F.col("failed"), "no model").when(F.col("hit"), "model")
    asks = f.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("again", F.col("reason").isin("unreadable", "no model"))
    order = Window.partitionBy("repo").orderBy("rank", "path")
    blocked = F.coalesce(F.max(F.col("again").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # few files a project: its directories' ancestors
    return asks.withColumn("n", F.row_number().over(order)).withColumn("blocked", blocked).where((F.col("blocked") == 0) & (F.col("n") <= MOST)).select("repo", "n", "path", "reason", "again")


def asked(calls: DataFrame, asks: DataFrame) -> DataFrame:
    """Adds ``guard_path`` to the calls (project, ts, event_id, ..) that ask about a file: the n-th call of a project about its n-th file, as each is reviewed by asking; the file that asks each time holds for all later calls.

    The first calls of a project are found by a rank limit, which Spark applies before the shuffle.
    """
    first = calls.select("project", "ts", "event_id").withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("ts", "event_id"))).where(F.col("n") <= MOST)
    one = first.join(asks.select(F.col("repo").alias("project"), "n", "path"), ["project", "n"]).select("event_id", F.col("path").alias("once"))
    last = asks.where("again").select(F.col("repo").alias("project"), "n", F.col("path").alias("always"))
    start = first.join(last, ["project", "n"]).select("project", "always", F.struct("ts", "event_id").alias("since"))
    out = calls.join(one, "event_id", "left").join(start, "project", "left")
    later = F.when(F.struct("ts", "event_id") >= F.col("since"), F.col("always"))
    return out.withColumn("guard_path", F.coalesce("once", later)).drop("once", "always", "since")
