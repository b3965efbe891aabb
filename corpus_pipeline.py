"""The cleaning pipeline of a training corpus: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``; between stages the rows are written and read again. Rows with a null text
pass the filters; a stage that changes a text sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbastion.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from textbastion.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from ``labels`` joined to the corpus itself."""
    docs = docs.select(*COLUMNS)
    index = toxicity.fit_packed(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).where("toxicity < 0.5 OR text IS NULL").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that at least 5 documents hold stay in the one with the largest doc_id only."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    changed = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return changed.withColumn("text", text).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays; of rows that repeat a doc_id one stays."""
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark)
    found = jaccard_join.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("__goes"), F.count(F.lit(1)).alias("__n"))
    odd = scratch.keep(found.where("__goes = 1 OR __n > 1"))
    kept = docs.join(odd.hint("shuffle_hash"), "doc_id", "left").where("__goes IS NULL OR __goes = 0")
    # only ids that repeat need a choice of their row
    once = kept.where("__n IS NULL").select(*COLUMNS)
    return once.unionByName(kept.where("__n > 1").dropDuplicates(["doc_id"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = decontamination.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]
#: Shingle sets, spaced seeds and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared scratch folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
