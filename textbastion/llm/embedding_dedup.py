"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random directions; in each of ``m`` sorted lists of projections a vector's window is centred at its
own value, and two vectors collide in a list if they lie within each other's window. Collisions are counted, and what has at least
``cut`` is verified by the exact cosine in double precision. A list is sorted by (cell, projection), where the cell is the sign
pattern of ``bits`` further directions, so that a window holds a bounded number of unrelated vectors: ``bits`` grows with the
logarithm of the number of vectors, and ``m`` is the least number of lists for which a pair right at the threshold reaches ``cut`` with
probability ``recall`` (a closed form of the angle; closer pairs are found more surely).

Exactly equal vectors are one vector with a multiplicity throughout, so a third of all rows may be copies of one. Groups of near vectors cost no more than their size in rows:

* In a cell that holds far more vectors than chance gives, the one with the smallest number leads, and those with a cosine of at least the threshold follow it.
* Collisions are counted between a leader (for all its followers) and vectors of other leaders; vectors of one leader need none.
* A leader's answers are its followers and the vectors that collide often enough with them. Blocks of followers are compared with the
  answers as these stream by, every pair exactly; links are counted, not written, and of the edges about one a vector and block is.

The records that are shuffled are (cell, projection, number), dealt by cell; vectors travel only to be verified.

Defined cases: null or zero vectors, and vectors with null or non-finite components, link with nothing; vectors of different lengths do not
link with each other; a null vec_id links with nothing and has a null component; rows that repeat a vec_id are vectors of their own
that link if their vectors do; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_group, components, partitions, runs, table


def calibrate(n: int, threshold: float, recall: float, cut: int = 2, per_cell: int = 12) -> tuple[int, int, float]:
    """(bits, lists, half width of a window in units of the projection) for n vectors."""
    bits = max(0, math.ceil(math.log2(max(1, n) / per_cell)))
    sigma = math.sqrt(2 - 2 * threshold)
    width = 1.8 * sigma
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(width / sigma / math.sqrt(2))
    m = cut
    while sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(cut)) > 1 - recall:
        m += 1
    return bits, m, width


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((count, dim))


def _rows(col: pa.Array) -> list[np.ndarray | None]:
    """Double vectors; None for those that link with nothing."""
    out = []
    for x in col:
        v = x.values if x.is_valid else None
        if v is None or not len(v) or v.null_count:
            out.append(None)
            continue
        a = v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(a if np.isfinite(a).all() and a.any() else None)
    return out


def distinct_vectors(scratch: Scratch, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of all rows, key null for those that link with nothing; (k, id, copies, key, v) of the distinct vectors, k a number of their own."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _rows(b.column("embedding"))
            ids = b.column("vec_id").to_pylist()
            # + 0.0 makes one zero of both
            raw = [None if r is None or i is None else (r + 0.0).tobytes() for r, i in zip(rows, ids)]
            key = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "v"])

    all_rows = scratch.keep(vectors.select("vec_id", "embedding").mapInArrow(keys, "vec_id long, key binary, v binary"))
    ids = scratch.keep(all_rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    # the vector itself once, from a row that has the smallest id (rows that repeat it are equal)
    own = all_rows.select("vec_id", "key", "v").join(ids.select("key", F.col("id").alias("vec_id"), "copies"), ["key", "vec_id"])
    one = own.dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("k"), F.col("vec_id").alias("id"), "copies", "key", "v")
    return all_rows.select("vec_id", "key"), scratch.keep(one)


def lines(distinct: DataFrame, bits: int, m: int, seed: int, some: int) -> DataFrame:
    """(cell, line, k): the first ``some`` of ``m`` lists, a vector's cell and projection in each."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                ids = b.column("k").to_numpy()
                raw = [np.frombuffer(x.as_buffer(), np.float64) for x in b.column("v")]
                for dim in sorted({len(x) for x in raw}):
                    i = [j for j, x in enumerate(raw) if len(x) == dim]
                    x = unit(np.stack([raw[j] for j in i]))
                    line = x @ directions(dim, m, seed)[:some].T
                    sign = (x @ directions(dim, m * bits, seed + 1)[: some * bits].T > 0).reshape(len(x), some, bits)
                    cell = (sign * (1 << np.arange(bits))).sum(2).astype(np.int64) if bits else np.zeros((len(x), some), np.int64)
                    cell = ((np.arange(some)[None] << bits) + cell) * 65537 + dim
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(line.astype(np.float32).ravel()), pa.array(np.repeat(ids[i], some))], ["cell", "line", "k"])

    return distinct.select("k", "v").mapInArrow(project, "cell long, line float, k long")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
    return (x @ y.T) / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1)))


def leaders(scratch: Scratch, distinct: DataFrame, bits: int, m: int, width: float, threshold: float, seed: int, some: int = 16, dense: int = 64) -> DataFrame:
    """(k, leader, many): whom each vector follows (itself if nobody), and whether its leader has several vectors.

    In the first ``some`` lists a cell of at least ``dense`` vectors proposes its smallest number to all that collide with it. A leader follows nobody.
    """
    some = min(some, m)
    cells = lines(distinct, bits, m, seed, some)
    first = scratch.keep(cells.groupBy("cell").agg(F.min(F.struct("k", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= dense).drop("n"))
    near = cells.join(first, "cell").where(F.abs(F.col("line") - F.col("first.line")) <= width).where("first.k <> k")
    pairs = near.select(F.col("first.k").alias("a"), F.col("k").alias("b")).distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            va, vb = ([np.frombuffer(x.as_buffer(), np.float64) for x in b.column(c)] for c in ("va", "vb"))
            ok = pa.array([len(x) == len(y) and bool(cosines(x[None], y[None])[0, 0] >= threshold) for x, y in zip(va, vb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    both = pairs.join(distinct.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(distinct.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    found = scratch.keep(both.mapInArrow(check, "a long, b long"))
    roots = found.join(found.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    follows = scratch.keep(roots.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("leader")))
    heads = follows.select("leader").distinct().select(F.col("leader").alias("k"), F.lit(True).alias("heads"))
    out = distinct.select("k").join(follows, "k", "left").join(heads, "k", "left")
    return scratch.keep(out.select("k", F.coalesce("leader", "k").alias("leader"), (F.col("leader").isNotNull() | F.coalesce("heads", F.lit(False))).alias("many")))


def crossing(distinct: DataFrame, led: DataFrame, n: int, bits: int, m: int, width: float, seed: int, cut: int) -> DataFrame:
    """(a, b): leaders a and vectors b of other leaders where b collides with a vector of a in at least ``cut`` lists."""

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "line", "k", "leader", "many")) for b in batches]
        if not parts:
            return
        cell, line, k, leader, many = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((line, leader, cell))
        cell, line, k, leader, many = (x[order] for x in (cell, line, k, leader, many))
        # the vectors of one leader in a cell are a stretch sorted by projection; each is met by all vectors of the cell's other stretches
        at = runs(cell, leader)[:-1]
        stretch = np.repeat(np.arange(len(at)), np.diff(at, append=len(k)))
        key = stretch * 1e6 + line.astype(np.float64)
        lo, hi = np.searchsorted(cell, cell[at], "left"), np.searchsorted(cell, cell[at], "right")
        cost = np.cumsum(hi - lo)
        edges = np.searchsorted(cost, np.arange(0, int(cost[-1]) + 1, 1 << 20)).tolist()
        for i, j in zip(edges, [*edges[1:], len(at)]):
            size = (hi - lo)[i:j]
            if not len(size):
                continue
            b = np.repeat(lo[i:j] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            s = np.repeat(np.arange(i, j), size)
            # of two vectors without followers only one side is counted; the other is added at the end
            ok = (leader[b] != leader[at[s]]) & (many[at[s]] | many[b] | (leader[at[s]] < k[b]))
            b, s = b[ok], s[ok]
            centre = line[b].astype(np.float64)
            p = np.searchsorted(key, s * 1e6 + centre - width)
            ok = (p < len(k)) & (stretch[np.minimum(p, len(k) - 1)] == s)
            ok[ok] = line[p[ok]] <= centre[ok] + width
            yield pa.RecordBatch.from_arrays([pa.array(leader[at[s[ok]]]), pa.array(k[b[ok]]), pa.array(~(many[at[s[ok]]] | many[b[ok]]))], ["a", "b", "mirror"])

    held = lines(distinct, bits, m, seed, m).join(led, "k")
    dealt = held.repartition(partitions(distinct.sparkSession, n * m, 100_000), "cell")
    return dealt.select("cell", "line", "k", "leader", "many").mapInArrow(collide, "a long, b long, mirror boolean").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("mirror").alias("mirror")).where(F.col("n") >= cut).select("a", "b", "mirror")


class Block:
    """Vectors of one leader, compared with others of its answers; counts links and keeps labels of what is connected."""

    def __init__(self, k: np.ndarray, x: np.ndarray, threshold: float):
        self.k, self.x, self.threshold = k, x, threshold
        self.links, self.label = np.zeros(len(k), np.int64), np.arange(len(k))

    def against(self, k: np.ndarray, y: np.ndarray, copies: np.ndarray, edges: set[tuple[int, int]]) -> None:
        link = (cosines(self.x, y) >= self.threshold) | (self.k[:, None] == k[None, :])
        self.links += link @ copies
        while True:
            low = np.where(link, self.label[:, None], len(self.k)).min(0)
            new = np.minimum(self.label, np.where(link, low[None, :], len(self.k)).min(1))
            moved = np.flatnonzero(new != self.label)
            if not len(moved):
                break
            edges |= {(int(self.k[i]), int(self.k[j])) for i, j in zip(self.label[moved].tolist(), new[moved].tolist())}
            self.label = new
        edges |= {(int(self.k[r]), int(v)) for r, v in zip(low.tolist(), k.tolist()) if r < len(self.k) and self.k[r] != v}


def linked(scratch: Scratch, distinct: DataFrame, threshold: float, recall: float, cut: int = 2, seed: int = 7, block: int = 1024) -> DataFrame:
    """(a, b, links): for each vector a with answers the rows that it or its copies link with, itself included (b null), and edges that connect what is linked."""
    spark = scratch.spark
    n = distinct.count()
    bits, m, width = calibrate(n, threshold, recall, cut)
    led = leaders(scratch, distinct, bits, m, width, threshold, seed)
    cross = scratch.keep(crossing(distinct, led, n, bits, m, width, seed, cut))
    mirrored = cross.where("mirror").select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = cross.select("a", "b").unionByName(mirrored).unionByName(led.where("many").select(F.col("leader").alias("a"), F.col("k").alias("b")))
    # a leader of its own is its only follower
    alone = led.where("NOT many").select("k").join(cross.select("a").unionByName(mirrored.select("a")).distinct(), F.col("a") == F.col("k"), "left_semi")
    pairs = scratch.keep(pairs.unionByName(alone.select(F.col("k").alias("a"), F.col("k").alias("b"))))
    blocks = led.groupBy("leader").agg(F.expr(f"(count(1) + {block - 1}) div {block}").alias("of"))
    sized = pairs.join(led.select(F.col("k").alias("b"), "leader"), "b").join(blocks.select(F.col("leader").alias("a"), "of"), "a")
    spread = sized.select("a", "b", F.when(F.col("leader") == F.col("a"), F.pmod(F.xxhash64("b"), F.col("of"))).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("block"))
    spread = spread.withColumn("role", F.when(F.col("own") == F.col("block"), 0).otherwise(1)).drop("own")
    rows = spread.join(distinct.select(F.col("k").alias("b"), "copies", "v"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, ["a", "block"]):
            own: list = []
            held: Block | None = None
            edges: set[tuple[int, int]] = set()

            def meet(k: np.ndarray, vectors: list, copies: np.ndarray) -> None:
                for lo in range(0, len(k), block):
                    same = np.array([i for i in range(lo, min(lo + block, len(k))) if len(vectors[i]) == held.x.shape[1]], np.int64)
                    if len(same):
                        held.against(k[same], np.stack([vectors[i] for i in same.tolist()]), copies[same], edges)

            def begin() -> Block:
                k, vectors, copies = (np.concatenate([o[0] for o in own]), [v for o in own for v in o[1]], np.concatenate([o[2] for o in own]))
                nonlocal held
                held = Block(k, np.stack(vectors), threshold)
                meet(k, vectors, copies)
                return held

            for part in group:
                k, role, copies = (part.column(c).to_numpy() for c in ("b", "role", "copies"))
                vectors = [np.frombuffer(x.as_buffer(), np.float64) for x in part.column("v")]
                mine = int((role == 0).sum())
                if mine:
                    own.append((k[:mine], vectors[:mine], copies[:mine]))
                if mine < len(k) and own:
                    held = held or begin()
                    meet(k[mine:], vectors[mine:], copies[mine:])
            if own:
                held = held or begin()
                a = held.k.tolist() + [e[0] for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(held.k) + [e[1] for e in edges], pa.int64()), pa.array(held.links.tolist() + [None] * len(edges), pa.int64())], ["a", "b", "links"])

    dealt = rows.repartition(partitions(spark, pairs.count(), 20_000), "a", "block").sortWithinPartitions("a", "block", "role")
    return scratch.keep(dealt.select("a", "block", "role", "b", "copies", "v").mapInArrow(compare, "a long, b long, links long"))


def dedup_embeddings(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession)
    rows, distinct = distinct_vectors(scratch, vectors)
    found = linked(scratch, distinct, threshold, recall)
    comp = scratch.keep(components(scratch, found.where("b IS NOT NULL").select("a", "b")))
    least = comp.join(distinct.select(F.col("k").alias("id"), F.col("id").alias("vec")), "id").groupBy("comp").agg(F.min("vec").alias("component_id"))
    member = comp.join(least, "comp").select(F.col("id").alias("k"), "component_id")
    links = found.where("links IS NOT NULL").select(F.col("a").alias("k"), "links")
    known = scratch.keep(distinct.select("k", "id", "copies", "key").join(links, "k", "left").join(member, "k", "left").select(
        "key", (F.coalesce("links", "copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    out = rows.where("key IS NOT NULL").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"))
