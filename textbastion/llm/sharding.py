"""Sharding by a Hilbert curve: quantise metadata, order by curve index, cut the order into runs.

``curve`` quantises each dimension to ``bits`` bits (numbers by quantiles over all rows, strings by the high bits of
their CRC-32, so no dictionary is gathered) and computes the Hilbert index with Skilling's transform, vectorised over
Arrow batches. ``ordered`` gives every row its global rank in (curve index, CRC-32 of the text, doc_id) order: a range
shuffle of narrow rows (no text), a local sort, and offsets from one count per partition. ``shard_rows`` cuts the ranks into
``shards`` runs whose row counts differ by one at most, so each shard covers a compact box of every dimension, and file
statistics prune on any of them. ``write_shards`` writes the runs as files in curve order.

Defined cases: nulls of a dimension take the lowest cell; a null text has no bytes (size 1) and CRC-32 0; rows that are equal in
all sort keys are ordered arbitrarily among themselves, but each gets a slot of its own; an empty table gives no rows.
A curve cell that holds a third of all rows is split over partitions and shards, as doc_id is part of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, table


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``cells`` (n x dims, unsigned, below 2 ** bits)."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


def string_cuts(df: DataFrame, column: str, cells: int, most: int = 4096) -> list[str]:
    """Values that cut a string column into at most ``cells`` stretches of like size, in the order of the values; every row counts.

    Up to ``most`` distinct values are cut on the driver; of more, only the values that end a stretch get there.
    """
    given = df.where(F.col(column).isNotNull())
    counted = given.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    rows = counted.limit(most + 1).collect()
    if len(rows) > most:
        return ranked_cuts(counted, column, cells)
    rows.sort(key=lambda r: r[0].encode())
    total, seen, cuts = sum(r[1] for r in rows), 0, []
    for r in rows[:-1]:
        seen += r[1]
        if seen * cells >= total * (len(cuts) + 1) and len(cuts) < cells - 1 or len(rows) <= cells:
            cuts.append(r[0])
    return cuts


def ranked_cuts(counted: DataFrame, column: str, cells: int) -> list[str]:
    """The values of ``counted`` (value, __n) at which the running count reaches a further ``cells``-th of all rows, but the greatest."""
    spark = counted.sparkSession
    scratch = Scratch(spark)
    values = scratch.keep(counted)
    n = partitions(spark, values.count(), 50_000)
    kept = scratch.keep(values.repartitionByRange(n, column).withColumn("__part", F.spark_partition_id()))
    # one row a partition
    sums = kept.groupBy("__part").agg(F.sum("__n").alias("__all"))
    before = sums.select("__part", (F.sum("__all").over(Window.orderBy("__part")) - F.col("__all")).alias("__before"))
    total = sums.agg(F.sum("__all")).first()[0]
    running = kept.withColumn("__seen", F.sum("__n").over(Window.partitionBy("__part").orderBy(column))).join(F.broadcast(before), "__part").withColumn("__seen", F.col("__seen") + F.col("__before"))
    ends = running.where(f"__seen < {total} AND (__seen * {cells}) div {total} > ((__seen - __n) * {cells}) div {total}").select(column).collect()
    scratch.drop(values, kept)
    return sorted((r[0] for r in ends), key=str.encode)


def quantised(df: DataFrame, column: str, bits: int) -> Column:
    """Cell 0 .. 2 ** bits - 1 of a column, in the order of its values, so that least and greatest values of a run of cells prune; nulls are in cell 0."""
    if dict(df.dtypes)[column] == "string":
        cuts, value = string_cuts(df, column, 1 << bits), F.col(column)
    else:
        found = df.select(F.percentile_approx(F.col(column).cast("double"), [i / (1 << bits) for i in range(1, 1 << bits)], 10_000).alias("c")).first().c
        cuts, value = sorted(set(found or ())), F.col(column).cast("double")
    if not cuts:
        return F.lit(0)
    # few values are spread over all cells: the curve's long stretches follow the high bits
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))
    return F.floor(F.coalesce(at, F.lit(0)) * (1 << bits) / (len(cuts) + 1)).cast("int")


def curve(df: DataFrame, dims: list[str], bits: int = 4) -> DataFrame:
    """``df`` plus its Hilbert index ``curve`` (long) over ``dims``; dims x bits is 63 at most."""
    if len(dims) * bits > 63:
        raise ValueError("dims x bits must be 63 at most")
    cells = df.select("*", F.array(*(quantised(df, c, bits) for c in dims)).alias("curve"))
    at = cells.schema.names.index("curve")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(dims))
            cols = list(b.columns)
            cols[at] = pa.array(hilbert_index(flat, bits).astype(np.int64))
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return cells.mapInArrow(index, df.select("*", F.lit(0).cast("long").alias("curve")).schema)


def ordered(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``df`` plus ``rank``, its place (from 0, gapless) in the order of ``keys``; and the number of rows."""
    scratch = Scratch(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    kept = scratch.keep(local.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__i")).drop("__at"))
    # one row a partition
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    return kept.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__i")).drop("__part", "__i", "__before"), total


def shard_rows(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """``df`` plus shard (int) and slot (long, from 0 within the shard), with row counts at most one apart."""
    ranked, total = ordered(df, keys)
    base, more = divmod(total, shards)
    wide = more * (base + 1)  # the first ``more`` shards have one row more
    rank = F.col("rank")
    if base == 0:
        shard, slot = rank, F.lit(0).cast("long")
    else:
        first = rank < wide
        shard = F.when(first, F.expr(f"rank div {base + 1}")).otherwise(F.expr(f"{more} + (rank - {wide}) div {base}"))
        slot = F.when(first, F.expr(f"rank % {base + 1}")).otherwise(F.expr(f"(rank - {wide}) % {base}"))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("rank")


def write_shards(df: DataFrame, dims: list[str], path: str, shards: int, bits: int = 4) -> None:
    """Write ``df`` to ``path``/shard=N in curve order; parquet statistics then prune on any of ``dims``."""
    tie = [c for c, kind in df.dtypes if kind in ("bigint", "int", "string")]
    cut = shard_rows(curve(df, dims, bits), ["curve", *dict.fromkeys(tie)], shards)
    cut.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").drop("curve", "slot").write.partitionBy("shard").parquet(path)


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``; dimensions: bytes of the text, language, source, doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    meta = Scratch(spark).keep(meta)  # the text is read once
    cut = shard_rows(curve(meta, ["size", "lang", "source", "doc_id"]), ["curve", "text_crc32", "doc_id"], 8)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
