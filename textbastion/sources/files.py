"""File sources: projects on disk, snapshots of them and what has changed, JSON lines of events, at rest and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import FOLDER, KINDS, SETTINGS
from ..operators.events import SCHEMA


def _rows(spark: SparkSession, root: str, paths: list[str], recursive: bool) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if len(hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop(p)) or [])]
    if not there:
        return spark.createDataFrame([], "repo string, path string, text string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(there)
    top = root.rstrip("/").split("://")[-1]
    top = top if "://" not in root else "/" + top.partition("/")[2]
    parts = F.split(F.substring_index(F.col("path"), top + "/", -1), "/")
    return raw.where(F.size(parts) > 1).select(F.get(parts, F.lit(0)).alias("repo"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, text) of all files below the projects in ``root`` (a folder of projects); text is null where the bytes are no UTF-8.

    Any store that Spark reads will do. Like every Spark source it leaves out hidden files and folders; see ``config_files`` for those.
    """
    return _rows(spark, root, [root], True)


def config_files(spark: SparkSession, root: str, folder: str = FOLDER) -> DataFrame:
    """``project_files`` of the configuration folder of each project, which may be hidden: one level of its folders, and the settings."""
    base = f"{root.rstrip('/')}/*/{folder}"
    return _rows(spark, root, [f"{base}/{k}/*" for k in KINDS if k != "settings"] + [f"{base}/{s}" for s in SETTINGS], False)


def changed(old: DataFrame, new: DataFrame, extensions: list[str] = ()) -> DataFrame:
    """(repo, path, text) of files that are new or differ from the old snapshot, with one of the extensions (any case) if there are any; deleted and unreadable ones drop out."""
    h = lambda df: df.select("repo", "path", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    now = new.where("text IS NOT NULL").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    if extensions:
        now = now.where(F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).isin([e.strip().lower() for e in extensions]))
    return now.join(h(old), ["repo", "path", "h"], "left_anti").drop("h")


def diff_report(scanned: DataFrame) -> DataFrame:
    """(scanned, detected, exit_code, files) from (path, verdict): one row, with the files that have a finding; exit code 1 if there are any."""
    bad = F.col("verdict") != "clean"
    rows = F.array_sort(F.collect_list(F.when(bad, F.concat_ws(": ", "path", "verdict"))))
    out = scanned.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(bad).alias("detected"), rows.alias("files"))
    return out.select("scanned", "detected", F.when(F.col("detected") > 0, 1).otherwise(0).alias("exit_code"), "files")


def event_lines(lines: DataFrame) -> DataFrame:
    """Parsed events of a column ``value`` of JSON lines: ``status`` ok, error (no JSON) or blank, and the fields."""
    h = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.withColumn("h", h)
    status = F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank").when(F.col("h._corrupt_record").isNotNull(), "error").otherwise("ok")
    return parsed.select(status.alias("status"), "h.*").drop("_corrupt_record")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return event_lines(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """``read_events`` over a folder that grows."""
    return event_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))
