"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by every document.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except in the document with
the largest doc_id that holds them. The keys are counted by their 128-bit hash in one aggregation (with a map-side part,
so a line that a third of all documents share costs one row a task). The repeated ones become shards of about ``PER_SHARD`` keys, each a minimal
perfect hash by displaced buckets over its keys with three arrays in slot order: 64-bit fingerprints, counts and largest
doc_ids. Documents then hash their lines again and probe the arrays.

The arrays take about 22 bytes a repeated key. Up to ``broadcast_mb`` MB of them (measured before anything is sent) go to the executors, and documents are
read and cut in one pass without a shuffle. Beyond that each shard stays in its own task: documents send their lines' hashes to the shards, salted
where a shard's keys have more than ``PER_SALT`` lines, and get back which to drop. The driver holds no shard then.

Defined cases: a null or empty text is one empty line; a row with a null doc_id counts as a document and is lower than
any other; rows that repeat a doc_id each count as a document and all of them with the largest doc_id keep the line; an empty table gives no rows; of input
columns with the names of the output the output's stay. Texts are taken in slices; a task holds the lines of one slice, or of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULT, Scratch, mix, partitions, slices, table

STRIP = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}
LOWEST = -(1 << 63)
U64 = np.uint64
#: Keys of a shard, lines of a shard's keys from which its probes are salted, and the mark of a slot instead of a seed.
PER_SHARD, PER_SALT, DIRECT = 4096, 1_000_000, np.uint32(1 << 31)


def _keys(lines: list[str], min_chars: int) -> list[tuple[int, str]]:
    out = []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(k := line.strip(STRIP)) >= min_chars:
            out.append((i, k.translate(FOLD) if not k.isascii() else k.lower()))
    return out


def place(h: np.ndarray, fp: np.ndarray, seed: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """Slot of a key for a seed; keys that differ in either half part for some seed."""
    s = np.asarray(seed, np.uint64)
    return (mix(mix(h + s * MULT) + fp * (s * U64(2) + U64(1))) % np.asarray(m, np.uint64)).astype(np.int64)


def build_shard(h: np.ndarray, fp: np.ndarray, n: np.ndarray, last: np.ndarray) -> bytes:
    """Hash, displace and compress: buckets of about 3 keys, the largest placed first, each by the first seed that fits; a bucket of one key names its slot."""
    m = len(h)
    buckets = max(1, m // 3)
    b = (h % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    starts = np.searchsorted(b[order], np.arange(buckets + 1))
    size = np.diff(starts)
    seeds = np.zeros(buckets, np.uint32)
    slot = np.empty(m, np.int64)
    free = np.ones(m, bool)
    for i in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
        own = order[starts[i] : starts[i + 1]]
        seed = 0
        while True:
            tried = np.arange(seed, seed + 64)
            at = np.sort(place(h[own][None, :], fp[own][None, :], tried[:, None], m), axis=1)
            fits = free[at].all(1) & (np.diff(at, axis=1) > 0).all(1)
            if fits.any():
                seed += int(fits.argmax())
                break
            seed += 64
        seeds[i], slot[own] = seed, place(h[own], fp[own], seed, m)
        free[slot[own]] = False
    alone = np.flatnonzero(size == 1)
    own = order[starts[alone]]
    slot[own] = np.flatnonzero(free)
    seeds[alone] = slot[own].astype(np.uint32) | DIRECT
    out = [np.empty(m, np.uint64), np.empty(m, np.uint32), np.empty(m, np.int64)]
    for a, v in zip(out, (fp, np.minimum(n, (1 << 32) - 1), last)):
        a[slot] = v
    return np.array([m, buckets], np.int64).tobytes() + seeds.tobytes() + b"".join(a.tobytes() for a in out)


class Shards:
    """Arrays of some of ``of`` shards one after the other, probed by (hash, fingerprint)."""

    def __init__(self, parts: dict[int, bytes], of: int):
        self.of = of
        self.shards = np.array(sorted(parts), np.int64)
        got: list[list[np.ndarray]] = [[], [], [], []]
        self.m, self.buckets = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for i, s in enumerate(self.shards.tolist()):
            m, buckets = self.m[i], self.buckets[i] = np.frombuffer(parts[s], np.int64, 2)
            at = 16
            for a, (dtype, size) in zip(got, ((np.uint32, buckets), (np.uint64, m), (np.uint32, m), (np.int64, m))):
                a.append(np.frombuffer(parts[s], dtype, size, at))
                at += a[-1].nbytes
        self.seeds, self.fps, self.counts, self.ids = (np.concatenate(a) if a else np.zeros(0, t) for a, t in zip(got, (np.uint32, np.uint64, np.uint32, np.int64)))
        self.slot0, self.seed0 = np.cumsum(self.m) - self.m, np.cumsum(self.buckets) - self.buckets

    def probe(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it is held, and the largest doc_id."""
        hit, last = np.zeros(len(h), bool), np.full(len(h), LOWEST, np.int64)
        if not len(self.shards):
            return hit, last
        shard = shard_of(h, self.of)
        i = np.searchsorted(self.shards, shard)
        i[i == len(self.shards)] = 0
        x = np.flatnonzero(self.shards[i] == shard)
        i, h, fp = i[x], h[x], fp[x]
        seed = self.seeds[self.seed0[i] + (h % self.buckets[i].astype(np.uint64)).astype(np.int64)]
        at = np.where(seed >= DIRECT, seed & ~DIRECT, place(h, fp, seed, self.m[i]).astype(np.uint64)).astype(np.int64) + self.slot0[i]
        ok = self.fps[at] == fp
        hit[x[ok]], last[x[ok]] = True, self.ids[at[ok]]
        return hit, last


def shard_of(h: np.ndarray, of: int) -> np.ndarray:
    return (mix(h) % U64(of)).astype(np.int64)


def line_keys(b: pa.RecordBatch, min_chars: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines of a slice, and of the long ones the two halves of the key's hash, the row and the number of the line."""
    lines = [(t or "").split("\n") for t in b.column("text").to_pylist()]
    body, row, at = [], [], []
    for r, x in enumerate(lines):
        for i, k in _keys(x, min_chars):
            body.append(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest()), row.append(r), at.append(i)
    h = np.frombuffer(b"".join(body), np.uint64).reshape(-1, 2)
    return lines, h[:, 0].copy(), h[:, 1].copy(), np.array(row, np.int64), np.array(at, np.int64)


def owners(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(b.column("doc_id").cast(pa.int64()), LOWEST).to_numpy(zero_copy_only=False)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(h, fp, n, last) of each key that at least ``min_docs`` documents hold."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for b in slices(batch):
                _, h, fp, row, _ = line_keys(b, min_chars)
                # a document counts once, and what a slice holds in several documents leaves it as one row
                order = np.lexsort((row, fp, h))
                h, fp, row = h[order], fp[order], row[order]
                key = np.ones(len(h) + 1, bool)
                key[1:-1] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
                new = key[:-1].copy()
                new[1:] |= row[1:] != row[:-1]
                at = np.flatnonzero(key)[:-1]
                if len(at):
                    found.append((h[at].view(np.int64), fp[at].view(np.int64), np.add.reduceat(new, at, dtype=np.int64), np.maximum.reduceat(owners(b)[row], at)))
            for x in found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["h", "fp", "n", "last"])

    rows = docs.select("doc_id", "text").mapInArrow(lines, "h long, fp long, n long, last long")
    return rows.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)


def shards(scratch: Scratch, keys: DataFrame) -> tuple[DataFrame, int]:
    """Table (shard, size, lines, body) of minimal perfect hash shards; lines is how many documents' lines its keys have."""
    spark = scratch.spark
    kept = scratch.keep(keys)
    of = max(1, -(-kept.count() // PER_SHARD))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = list(batches)
        if not t:
            return
        t = pa.Table.from_batches(t)
        h, fp, n, last, shard = (t.column(c).to_numpy() for c in ("h", "fp", "n", "last", "shard"))
        for s in np.unique(shard).tolist():
            i = shard == s
            body = build_shard(h[i].view(np.uint64), fp[i].view(np.uint64), n[i], last[i])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([int(n[i].sum())], pa.int64()), pa.array([body], pa.binary())], ["shard", "size", "lines", "body"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = shard_of(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), of)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], [*b.schema.names, "shard"])

    dealt = kept.mapInArrow(deal, "h long, fp long, n long, last long, shard long").repartition(partitions(spark, of, 8, min(of, 6)), "shard")
    out = scratch.keep(dealt.mapInArrow(build, "shard long, size long, lines long, body binary"))
    scratch.drop(kept)
    return out, of


def cut_out(b: pa.RecordBatch, names: list[str], lines: list[list[str]], gone: dict[int, set[int]]) -> pa.RecordBatch:
    """The columns ``names`` of a slice with its number of lines, the number of those that go, and the rest."""
    text = b.column("text").to_pylist()
    kept = ["\n".join(x for i, x in enumerate(lines[r]) if i not in gone[r]) if r in gone else t or "" for r, t in enumerate(text)]
    counts = pa.array([len(x) for x in lines], pa.int64()), pa.array([len(gone.get(r, ())) for r in range(len(lines))], pa.int64())
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *counts, pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept_text"])


def by_row(row: np.ndarray, at: np.ndarray) -> dict[int, set[int]]:
    gone: dict[int, set[int]] = {}
    for r, i in zip(row.tolist(), at.tolist()):
        gone.setdefault(r, set()).add(i)
    return gone


def dropped_by_shard(scratch: Scratch, docs: DataFrame, built: DataFrame, of: int, min_chars: int) -> DataFrame:
    """(owner, gone): the 16-byte hashes of the keys that a document (null ids: the lowest) loses. Every shard is probed in tasks of its own."""
    spark = scratch.spark
    hot = built.where(F.col("lines") > PER_SALT).select("shard", F.expr(f"(lines + {PER_SALT - 1}) div {PER_SALT}").alias("salts"))
    salts = spark.sparkContext.broadcast(dict(hot.collect()))  # at most one entry for PER_SALT lines of the corpus

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number = np.array(sorted(salts.value), np.int64), np.array([salts.value[s] for s in sorted(salts.value)], np.int64)
        for batch in batches:
            for b in slices(batch):
                _, h, fp, row, _ = line_keys(b, min_chars)
                if not len(h):
                    continue
                own, shard, salt = owners(b)[row], shard_of(h, of), np.zeros(len(h), np.int64)
                if len(names):
                    i = np.minimum(np.searchsorted(names, shard), len(names) - 1)
                    salt = np.where(names[i] == shard, (mix(own.view(np.uint64)) % number[i].astype(np.uint64)).astype(np.int64), 0)
                order = np.lexsort((salt, shard))
                at = np.flatnonzero(np.append(True, (np.diff(shard[order]) != 0) | (np.diff(salt[order]) != 0)))
                body = np.stack([h.view(np.int64), fp.view(np.int64), own], 1)[order]
                blobs = [body[i:j].tobytes() for i, j in zip(at.tolist(), [*at[1:].tolist(), len(order)])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[order][at]), pa.array(salt[order][at]), pa.array([1] * len(at), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "salt", "kind", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for b in batches:
            for shard, kind, body in zip(b.column("shard").to_pylist(), b.column("kind").to_pylist(), b.column("body")):
                if kind == 0:
                    held, now = Shards({shard: body.as_py()}, of), shard
                elif shard == now:
                    x = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, 3)
                    hit, last = held.probe(x[:, 0].copy().view(np.uint64), x[:, 1].copy().view(np.uint64))
                    x = x[hit & (last != x[:, 2])]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x[:, 2].copy()), pa.array([r.tobytes() for r in x[:, :2].copy()], pa.binary())], ["owner", "key"])

    number = F.expr("0").cast("long") if not salts.value else F.coalesce(F.col("salts") - 1, F.lit(0).cast("long"))
    bodies = built.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), number)).alias("salt"), F.lit(0).cast("long").alias("kind"), "body")
    asked = docs.select("doc_id", "text").mapInArrow(ask, "shard long, salt long, kind long, body binary")
    dealt = bodies.unionByName(asked).repartition(partitions(spark, of, 8), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInArrow(answer, "owner long, key binary").groupBy("owner").agg(F.collect_set("key").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_mb: int = 64) -> DataFrame:
    """All columns of ``docs`` plus (or with, where they are there) n_lines, n_dropped and kept_text (null texts give the empty text)."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "__owner", "__gone")
    scratch = Scratch(docs.sparkSession)
    built, of = shards(scratch, repeated_lines(docs, min_chars, min_docs))
    names = docs.columns
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit("").alias("kept_text")).schema
    if (built.agg(F.sum("size")).first()[0] or 0) <= broadcast_mb << 20:
        sent = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.body) for r in built.select("shard", "body").collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = Shards(sent.value, of)
            for batch in batches:
                for b in slices(batch):
                    lines, h, fp, row, at = line_keys(b, min_chars)
                    hit, last = arrays.probe(h, fp)
                    drop = hit & (last != owners(b)[row])
                    yield cut_out(b, names, lines, by_row(row[drop], at[drop]))

        return docs.mapInArrow(probe, schema)
    lost = dropped_by_shard(scratch, docs, built, of, min_chars)
    joined = docs.withColumn("__owner", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).join(lost.select(F.col("owner").alias("__owner"), F.col("gone").alias("__gone")), "__owner", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                lines, h, fp, row, at = line_keys(b, min_chars)
                keys = np.stack([h, fp], 1).tobytes()
                lost = [set(g or ()) for g in b.column("__gone").to_pylist()]
                drop = np.array([keys[16 * i : 16 * i + 16] in lost[r] for i, r in enumerate(row.tolist())], bool)
                yield cut_out(b, names, lines, by_row(row[drop], at[drop]))

    return joined.mapInArrow(cut, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, i, line, h.k IS NOT NULL AND h.last <> doc_id AS gone FROM keyed LEFT JOIN heavy h ON keyed.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
