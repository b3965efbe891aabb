"""Shared pieces of the corpus operators: scratch tables, Arrow text access, rolling hashes, components.

Conventions that hold for every operator of this subpackage:

* inputs are read by column name and only the named columns are used, so extra columns never clash;
* a null text counts as the empty text unless the operator says otherwise;
* intermediate results are written as Parquet into the folder named by ``spark.checkpoint.dir`` (shared by
  driver and executors), which cuts lineage and survives the loss of executors; the shuffles behind them go at once.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Spark's setting that removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on a batch sent to or from Python, by default 64 MB; the JVM and the worker each hold such a batch beside their heaps.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the shared checkpoint folder, dropped one by one or all at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"{tempfile.gettempdir()}/checkpoints"  # one machine
        self.root = f"{root.rstrip('/')}/tb-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # shuffle files stay else until the driver happens to collect its garbage
        held = {CLEANUP: "true", BATCH: "8m"}
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in held}
        for k, v in held.items():
            conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return what reads it; its path is in ``.path``."""
        schema, path = df.schema, self.write(df)
        out = self.spark.read.schema(schema).parquet(path)
        out.path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(df.path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        # let the cleaner remove shuffle files of plans that are no longer referenced
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession, rows: int, per: int, least: int = 0) -> int:
    """Number of partitions for ``rows`` at ``per`` rows each; it grows with the input."""
    return max(least or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def release() -> None:
    """Gives memory that is free back to the system: workers live on from task to task, and their allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- Arrow text

def text_column(col: pa.Array) -> pa.Array:
    return pc.fill_null(col.cast(pa.large_string()), "")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets into them."""
    col = text_column(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text (at least one row each), to bound memory."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), len(keys[0]))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Groups of adjacent rows with equal (long) keys, each as an iterator of slices that has to be used up first."""
    held: list = []

    def parts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for b in batches:
            if b.num_rows:
                at = runs(*(b.column(k).to_numpy() for k in keys)).tolist()
                for i, j in zip(at, at[1:]):
                    yield tuple(b.column(k)[i].as_py() for k in keys), b.slice(i, j - i)

    feed = parts()

    def rest(key: tuple) -> Iterator[pa.RecordBatch]:
        while held and held[0][0] == key:
            yield held.pop()[1]
            held.extend(x for x in [next(feed, None)] if x)

    held.extend(x for x in [next(feed, None)] if x)
    while held:
        yield held[0][0], rest(held[0][0])


# ---------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
MULT = U64(0x9E3779B97F4A7C15)
_inv = U64(pow(int(MULT), -1, 1 << 64))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are no part of a run of ASCII letters, digits and non-ASCII bytes.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_WORD[_a:_b] = False
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** k and its inverse mod 2 ** 64 for k < n, kept for the largest n so far."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", MULT), ("down", _inv)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_PLACES: dict[str, np.ndarray] = {}


def places(n: int) -> np.ndarray:
    """A random odd 64-bit factor for each of the first n places of a word, kept for the largest n so far."""
    if len(_PLACES.get("by", ())) < n:
        _PLACES["by"] = np.random.Generator(np.random.PCG64(20240608)).integers(1, 1 << 63, max(n, 1 << 10), dtype=np.uint64) * U64(2) + U64(1)
    return _PLACES["by"][:n]


def words(raw: np.ndarray, off: np.ndarray, table: np.ndarray = LOWER, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` (or of bytes not in ``space``; case folded by ``table``), and the index of its first word for each text.

    Returns (hashes, first) with ``first`` of length n + 1. The hash is multilinear: each place of a word has a random factor
    of its own, so that words of any regular build collide no more often than others.
    """
    gap = space[raw]
    inside = np.flatnonzero(~gap)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    start = ~gap
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    start[1:] &= gap[:-1] | cut[1:-1]
    s = np.flatnonzero(start)
    at = np.flatnonzero(start[inside])
    length = np.diff(at, append=len(inside))
    h = np.add.reduceat(table[raw[inside]] * places(int(length.max()))[inside - np.repeat(s, length)], at)
    return mix(h + length.astype(np.uint64) * MULT), np.searchsorted(s, off)


SHINGLE = 5
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _COEF[0]
    for i in range(1, k):
        out += h[i : i + n] * _COEF[i]
    return mix(out)


def shingle_sets(col: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct k-word shingle hashes; fewer words form one shingle, none an empty set."""
    raw, off = buffers(col)
    h, first = words(raw, off)
    w = windows(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            x = np.sort(w[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix((h[a:b] * _COEF[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------- components

def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): a table (id, comp) with the smallest id that each id reaches.

    Every round replaces an edge (u, v) by edges to the smallest neighbour of u, and checks for an end with one
    count; the number of rounds grows with the logarithm of a component's diameter. Nothing is collected. Joins are
    between written tables, so that AQE can split the partitions of a hub.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        moved = both.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        # an edge from each id to its own minimum keeps it connected
        nxt = scratch.keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # it is a forest of stars when no id is both a leaf and a centre, and each leaf has one centre
        leaves = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        bad = leaves.where("n > 1").select("u").unionByName(nxt.select("v").distinct().join(leaves, F.col("v") == F.col("u"), "left_semi").select(F.col("v").alias("u")))
        done = bad.limit(1).count() == 0
        scratch.drop(e, low)
        e = nxt
        if done:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
