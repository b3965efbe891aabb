"""Exact substring dedup: removes each byte covered by a ``length``-byte string that also starts anywhere else.

Prefix-free parsing, restricted to what has to be compared. A rolling hash of every ``GRAM`` bytes makes triggers: the least
hash of each run of ``w`` grams (so any window of ``length`` bytes holds one, whatever the text). They cut the corpus into phrases that
depend on the text alone. The core of a window is the phrases from its first to its last trigger; neighbouring windows with one core are
a run, whose cover is all bytes of its windows. Equal windows have equal cores, so:

1. Runs are sorted by (core, cover), in shards by core. A core that occurs once rules its windows out; that is most of the corpus. A cover that
   occurs again settles its whole run: every window of it is repeated.
2. Only cores with several different covers are left (the ends of repeated passages). The windows of one run per cover are hashed
   and sorted, in shards by window; those that occur again are repeated.

Suffix arrays of dictionary and parse are not built: sorting them over a whole corpus takes a global sort for every doubling of the order, for text that is mostly
unique. Phrases are compared by hash in the same order instead, first by parse (the core), then by the bytes at the ends.

Covers and windows are compared by 96 bits of two independent hashes, cores (which only bring candidates together) by one. Lists travel as packed arrays. Copies within a slice of a task are counted before the
shuffle, so a text that a third of all documents copy adds one entry a slice, and windows of a hot passage are dealt one by one. A core that many documents go on from in different ways (the end of a
shared passage) is hot: cores that a task holds ``LOCAL`` times are counted, and those with more than ``HOT`` entries are dealt over several shards by cover and go to step 2 as a whole.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; matches within one document and overlapping ones count; repeated
rows are copies of each other; rows that repeat a doc_id with another text are documents of their own; strings are judged on the input only; an empty table gives no rows; extra columns are not read.
A task holds one slice of texts, or the longest text (about 60 bytes a byte of it), and one shard of runs or windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, MULT, Scratch, buffers, mix, partitions, powers, slices, table

LENGTH, GRAM = 200, 12
U64 = np.uint64
#: Occurrences of a core in a task from which it is counted, and entries of a core that one shard takes.
LOCAL, HOT = 32, 100_000
#: A row is told by the hash of its doc_id and text, and 32 bits of another hash of its doc_id.
NOTE = {"rid": np.int64, "doc": np.int32, "lo": np.int32, "n": np.int32, "flag": np.int8}
NOTE_DDL = "g long, kind int, rid binary, doc binary, lo binary, n binary, flag binary"
#: Bytes again, for a second hash of other values.
OTHER = mix(BYTE) | U64(1)


def _prefix(raw: np.ndarray, table: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[:-1], out=total[1:])
    return total, down


def runs(raw: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, core, cover, second hash of the cover) of every run; windows are places within the text."""
    w = (length - GRAM) // 2 - 4
    ns = len(raw) - length + 1
    if ns <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, *[z.astype(np.uint64)] * 3
    total, down = _prefix(raw)
    x = mix((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1]) & U64(0xFFFFFFFF00000000) | np.arange(len(raw) - GRAM + 1, dtype=np.uint64)
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    if step < w:
        x = np.minimum(x[: len(x) - (w - step)], x[w - step :])
    least = (x & U64(0xFFFFFFFF)).astype(np.int64)
    p1, p2 = least[:ns], least[length - GRAM - w + 1 :][:ns]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:ns]
    new = np.ones(ns, bool)
    new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], ns)
    # a text's last windows that would reach into the next one are no windows
    end = np.minimum(end, np.maximum(off[1:][row[at]] - length + 1, at))
    keep = end > at
    at, end = at[keep], end[keep]
    core = mix((total[p2[at] + GRAM] - total[p1[at]]) * down[p1[at]] + (p2[at] - p1[at]).astype(np.uint64) * MULT)
    cover = mix((total[end - 1 + length] - total[at]) * down[at] + (p1[at] - at).astype(np.uint64) * MULT + (end - at).astype(np.uint64))
    total, _ = _prefix(raw, OTHER)
    second = mix((total[end - 1 + length] - total[at]) * down[at] + (p1[at] - at).astype(np.uint64) * MULT + (end - at).astype(np.uint64))
    return row[at], at - off[row[at]], end - at, core, cover, second


def _blobs(bucket: np.ndarray, cols: dict[str, np.ndarray], extra: dict[str, int], key: str) -> pa.RecordBatch:
    """One row per bucket with the packed columns of its entries."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b, prepend=-1, append=np.iinfo(np.int64).max))
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    packed = [pa.array([x[order[i:j]].tobytes() for i, j in spans], pa.binary()) for x in cols.values()]
    return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]]), *(pa.array([v] * len(spans), pa.int32()) for v in extra.values()), *packed], [key, *extra, *cols])


def _read(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    parts: dict[str, list[bytes]] = {c: [] for c in kinds}
    for b in batches:
        for c in kinds:
            parts[c] += b.column(c).to_pylist()
    return {c: np.frombuffer(b"".join(parts.pop(c)), t) for c, t in kinds.items()}


def _notes(rid, doc, lo, n, flag, kind: int, groups: int) -> pa.RecordBatch:
    return _blobs(rid % groups, {"rid": rid, "doc": doc, "lo": lo.astype(np.int32), "n": n.astype(np.int32), "flag": flag.astype(np.int8)}, {"kind": kind}, "g")


SETTLED, ASKED = 0, 1


def _docs(b: pa.RecordBatch) -> np.ndarray:
    ids = pc.fill_null(b.column("doc_id").cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)
    return (mix(ids.astype(np.int64).view(np.uint64)) >> U64(32)).astype(np.uint32).view(np.int32)


def hot_cores(docs: DataFrame, length: int) -> DataFrame:
    """(core, n) of the cores with more than HOT entries, as far as tasks hold them LOCAL times: at most one row for HOT entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for b in slices(batch):
                _, _, _, core, cover, _ = runs(*buffers(b.column("text")), length)
                held.append(core[np.unique(cover, return_index=True)[1]])
        core, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = n >= LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(core[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["core", "n"])

    return docs.select("text").mapInArrow(count, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)


def deliver(docs: DataFrame, notes: DataFrame, groups: int, work: Callable, schema: str) -> DataFrame:
    """Bring the notes (by rid) and the texts together; ``work(batch, notes of the batch's rows)`` yields record batches.

    Texts and packed notes are dealt by the same group and sorted so that a group's notes come first.
    """

    texts = docs.select(F.pmod("rid", F.lit(groups)).alias("g"), F.lit(1).alias("part"), F.col("rid").alias("r"), "doc_id", "text")
    empty = {c: F.lit(None).cast("binary").alias(c) for c in NOTE}
    both = texts.select("*", *empty.values()).unionByName(
        notes.select("g", F.lit(0).alias("part"), F.lit(None).cast("long").alias("r"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *NOTE))
    dealt = both.repartition(partitions(docs.sparkSession, groups, 2), "g").sortWithinPartitions("g", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, index = None, [], None
        for batch in batches:
            g, part = batch.column("g").to_numpy(), batch.column("part").to_numpy()
            cut = np.flatnonzero(np.diff(g * 2 + part, prepend=-1, append=-1))
            cut = [0, *cut[cut > 0].tolist()] if len(g) else []
            for i, j in zip(cut, cut[1:]):
                b = batch.slice(i, j - i)
                if g[i] != now:
                    now, parts, index = g[i], [], None
                if part[i] == 0:
                    parts.append(b)
                    continue
                if index is None:
                    x = _read(parts, NOTE)
                    order = np.lexsort((x["doc"], x["rid"]))
                    names = np.stack([x["rid"], x["doc"]], 1)[order].view([("r", np.int64), ("d", np.int64)]).ravel()
                    index = {c: v[order] for c, v in x.items()}
                    parts = []
                for s in slices(b):
                    own = np.stack([s.column("r").to_numpy(), _docs(s)], 1).view([("r", np.int64), ("d", np.int64)]).ravel()
                    lo, hi = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
                    yield from work(s, index, lo, hi)

    return dealt.mapInArrow(run, schema)


def repeated_windows(scratch: Scratch, docs: DataFrame, groups: int, size: int, length: int = LENGTH) -> DataFrame:
    """Notes (g, kind, rid, lo, n, flag): windows lo .. lo + n - 1 of row rid are repeated. ``size``: bytes of all texts."""
    spark = scratch.spark
    buckets = max(1, -(-size // 2_000_000))
    found = sorted((r.core % (1 << 64), -(-r.n // HOT)) for r in hot_cores(docs, length).collect())
    hot = spark.sparkContext.broadcast((np.array([c for c, _ in found], np.uint64), np.array([n for _, n in found], np.uint64)))

    def shard(core: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a run is dealt, and whether its core is known to have several covers."""
        cores, of = hot.value
        if not len(cores):
            return (core % U64(buckets)).astype(np.int64), np.zeros(len(core), bool)
        i = np.minimum(np.searchsorted(cores, core), len(cores) - 1)
        many = cores[i] == core
        return ((core + np.where(many, mix(cover) % of[i], U64(0))) % U64(buckets)).astype(np.int64), many

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                row, lo, n, core, cover, second = runs(*buffers(b.column("text")), length)
                if not len(row):
                    continue
                rid, doc = b.column("rid").to_numpy()[row], _docs(b)[row]
                where, many = shard(core, cover)
                _, first, inverse, times = np.unique(np.stack([cover, second], 1).view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True, return_inverse=True, return_counts=True)
                # several in this slice: all but one are settled here
                again = times[inverse] > 1
                again[first] = False
                if again.any():
                    # settled ones need no partner: they go anywhere
                    anywhere = (mix(rid[again].view(np.uint64)) % U64(buckets)).astype(np.int64)
                    yield _entries(anywhere, rid[again], doc[again], lo[again], n[again], core[again], cover[again], second[again], np.full(again.sum(), 2))
                yield _entries(where[first], rid[first], doc[first], lo[first], n[first], core[first], cover[first], second[first], np.minimum(times, 2) + 4 * many[first])

    kinds = {"rid": np.int64, "doc": np.int32, "lo": np.int32, "n": np.int16, "core": np.uint64, "cover": np.uint64, "second": np.uint32, "times": np.int8}

    def _entries(bucket, rid, doc, lo, n, core, cover, second, times) -> pa.RecordBatch:
        """``times`` is 1 or 2 (several in the slice), and 4 more where the core is hot."""
        return _blobs(bucket, {"rid": rid, "doc": doc, "lo": lo.astype(np.int32), "n": n.astype(np.int16), "core": core, "cover": cover, "second": (second >> U64(32)).astype(np.uint32), "times": times.astype(np.int8)}, {}, "bucket")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _read(batches, kinds)
        if not len(x["rid"]):
            return
        order = np.lexsort((x["second"], x["cover"], x["core"]))
        core, cover, second, times = x["core"][order], x["cover"][order], x["second"][order], x["times"][order].astype(np.int64)
        many, times = times >= 4, times & 3
        new_core = np.ones(len(order), bool)
        new_core[1:] = core[1:] != core[:-1]
        new = new_core.copy()
        new[1:] |= (cover[1:] != cover[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        total = np.add.reduceat(times, at)
        again = total[which] > 1
        i = order[again]
        if len(i):
            yield _notes(x["rid"][i], x["doc"][i], x["lo"][i], x["n"][i], np.ones(len(i)), SETTLED, groups)
        group = np.cumsum(new_core) - 1
        several = (np.bincount(group, new)[group] > 1) | many
        ask = new & several
        i = order[ask]
        if len(i):
            yield _notes(x["rid"][i], x["doc"][i], x["lo"][i], x["n"][i], total[which[ask]] == 1, ASKED, groups)

    cols = "bucket long, " + ", ".join(f"{c} binary" for c in kinds)
    first = scratch.keep(docs.select("rid", "doc_id", "text").mapInArrow(parse, cols).repartition(partitions(spark, buckets, 2), "bucket").mapInArrow(settle, NOTE_DDL))

    def hashes(b: pa.RecordBatch, notes: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not (hi > lo).any():
            return
        raw, off = buffers(b.column("text"))
        total, down = _prefix(raw)
        k = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        doc = np.repeat(np.arange(len(lo)), hi - lo)
        n = notes["n"][k].astype(np.int64)
        s = np.repeat(notes["lo"][k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc = np.repeat(doc, n)
        a = off[doc] + s
        h = mix((total[a + length] - total[a]) * down[a])
        total, _ = _prefix(raw, OTHER)
        second = mix((total[a + length] - total[a]) * down[a])
        yield _blobs((h % U64(many)).astype(np.int64), {"rid": b.column("r").to_numpy()[doc], "doc": _docs(b)[doc], "lo": s.astype(np.int32), "h": h, "second": (second >> U64(32)).astype(np.uint32), "flag": np.repeat(notes["flag"][k], n)}, {}, "bucket")

    asked = first.where(F.col("kind") == ASKED)
    many = max(1, int((asked.agg(F.sum(F.octet_length("lo") / 4)).first()[0] or 0) * 25 // 200_000))
    wkinds = {"rid": np.int64, "doc": np.int32, "lo": np.int32, "h": np.uint64, "second": np.uint32, "flag": np.int8}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _read(batches, wkinds)
        if not len(x["rid"]):
            return
        order = np.lexsort((x["second"], x["h"]))
        h, second = x["h"][order], x["second"][order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = (h[1:] == h[:-1]) & (second[1:] == second[:-1])
        i = order[(same[1:] | same[:-1]) & (x["flag"][order] == 1)]
        if len(i):
            yield _notes(x["rid"][i], x["doc"][i], x["lo"][i], np.ones(len(i)), np.ones(len(i)), SETTLED, groups)

    windows = deliver(docs, asked, groups, hashes, "bucket long, " + ", ".join(f"{c} binary" for c in wkinds))
    second = scratch.keep(windows.repartition(partitions(spark, many, 1), "bucket").mapInArrow(compare, NOTE_DDL))
    return first.where(F.col("kind") == SETTLED).unionByName(second)


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = max(1, -(-size // 8_000_000))
    notes = repeated_windows(scratch, docs, groups, size, length)

    def cut(b: pa.RecordBatch, x: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw, off = buffers(b.column("text"))
        removed, spans, kept = [], [], []
        for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            text = raw[a:z]
            if hi[i] == lo[i]:
                removed.append(0), spans.append(0), kept.append(text.tobytes())
                continue
            first = x["lo"][lo[i] : hi[i]]
            step = np.bincount(first, minlength=z - a + 1) - np.bincount(first + x["n"][lo[i] : hi[i]] - 1 + length, minlength=z - a + 1)
            gone = np.cumsum(step)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return deliver(docs, notes, groups, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
