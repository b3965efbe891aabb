"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles; two documents link when intersection / union >= 0.75 (exactly, in integers).
Equal sets are one set throughout, so thousands of copies cost one.

1. *Repeated tokens.* A token that only one set holds leads to no partner, and a linked set shares at least 3/4 of its tokens; sets
   with fewer repeated tokens leave (``alive_sets``). The counts are exact, in buckets of tokens dealt by hash.
2. *Leaders.* Each set that stays is listed under the few of its repeated tokens with the least hash; the set of such a list with the smallest
   share of tokens of its own leads, and the others follow it where they overlap enough. A follower is kept as what differs from its leader:
   D, the leader's tokens it lacks, and A, the tokens it adds.
3. *Index-level skipping.* The prefixes (the least frequent quarter of a set by exact counts, which any partner shares a token with) form inverted
   lists. A list holds one entry for each leader in it, for all its followers there; an entry at position p can only reach partners up to a size that
   falls with p, so the blocks of the list sorted by size are skipped from there on. This gives each leader L its answers A(L): its followers and the sets of
   other leaders that one of its followers may link with. A group of near copies with one leader gives no pairs but (leader, follower).
4. *Answer-level skipping.* The answers of every follower come out of its leader's: with ``w = 4|D| + 3|A|``, sets M and N link if and only if
   ``w(M) + w(N) <= |L| + 7c``, where c counts what D and A of M and N have in common. Where the sum stays within ``|L|`` the link is certain
   without looking at any token; for the others c is derived from the differences, never from the sets. A leader with many followers is dealt in blocks of followers,
   each read against the leader's answers as they stream by. Links are counted, not written; what connects components is written, at most about one edge a set and block.

Defined cases: null or blank text: empty set, no link; repeated rows are equal sets and link with each other; rows that repeat a doc_id with another text are one vertex
that has the links of either, and n_links counts rows; a null doc_id takes the component of an equal set or null and counts in nobody's links; an empty table gives no rows; extra columns are not read.
The memory of a task is bounded by its slice of texts, its bucket of tokens, and the longest set (8 bytes a word); a set is never split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_group, components, mix, partitions, release, runs, shingle_sets, slices, table

#: Tokens that get a set its leader, overlap (in percent) with a leader to follow it, followers in a block, tokens in a bucket.
HEADS, FOLLOW, BLOCK, BUCKET = 6, 40, 1024, 2_000_000
#: Tokens that a task gathers before it sends them, and ranges of a bucket's tokens that are counted one by one.
FLUSH, RANGES = 1_000_000, 8
#: Bits of the filter that keeps texts without a partner out of a shuffle.
FILTER = 1 << 26
U64 = np.uint64
LOW = U64((1 << 32) - 1)


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n shares with any partner at least."""
    return (3 * n + 3) // 4


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, name, n, slack): 128-bit hash of the set, its first half as a number, and size; slack counts tokens that share their low half with another of the set."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sig, n, slack = [], [], []
                for s in shingle_sets(b.column("text")):
                    n.append(len(s)), sig.append(signature(s) if len(s) else None)
                    slack.append(len(s) - len(np.unique(s & LOW)))
                name = [None if g is None else int.from_bytes(g[:8], "little", signed=True) for g in sig]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.binary()), pa.array(name, pa.int64()), pa.array(n, pa.int32()), pa.array(slack, pa.int32())], ["doc_id", "sig", "name", "n", "slack"])

    return docs.select("doc_id", "text").mapInArrow(take, "doc_id long, sig binary, name long, n int, slack int")


def send_sets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, token, own, sigs) of the sets of these texts, each set once, by FLUSH tokens at a time."""
    seen: set[bytes] = set()
    sigs: list[bytes] = []
    sets: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        bucket = ((token >> U64(32)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = runs(bucket[order])
        names = np.frombuffer(b"".join(sigs), np.uint64)
        out: list[list] = [[], [], [], []]
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            x = order[i:j]
            own = owner[x]
            u = own[runs(own)[:-1]]  # the owners ascend within a bucket
            for col, v in zip(out, (int(bucket[x[0]]), (token[x] & LOW).astype(np.uint32).tobytes(), np.searchsorted(u, own).astype(np.uint16).tobytes(), names[u].tobytes())):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "token", "own", "sigs"])

    release()
    for batch in batches:
        for b in slices(batch):
            for s in shingle_sets(b.column("text")):
                if len(s) and (g := signature(s)[:8]) not in seen:
                    seen.add(g), sigs.append(g), sets.append(s)
                    size += len(s)
                if size > FLUSH or len(sets) == 1 << 16:
                    yield flush()
                    sigs, sets, size = [], [], 0
    if sets:
        yield flush()
    release()


def count_repeated(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, name, rep) from what ``send_sets`` gives, sorted by bucket. A bucket is held at 8 bytes a token and counted by RANGES of its tokens."""
    release()
    for _, group in by_group(batches, ["bucket"]):
        token, own, sigs = [], [], []
        for b in group:
            for t, o, g in zip(b.column("token"), b.column("own"), b.column("sigs")):
                token.append(np.frombuffer(t.as_buffer(), np.uint32)), own.append(np.frombuffer(o.as_buffer(), np.uint16))
                sigs.append(np.frombuffer(g.as_buffer(), np.int64))
        names, inverse = np.unique(np.concatenate(sigs), return_inverse=True)
        cuts = np.cumsum([len(g) for g in sigs])[:-1]
        own = np.concatenate([m[o] for m, o in zip(np.split(inverse.astype(np.uint32), cuts), own)])
        token = np.concatenate(token)
        rep = np.zeros(len(names), np.int64)
        for r in range(RANGES):
            of = np.flatnonzero(token // np.uint32((1 << 32) // RANGES) == r)
            x = np.unique(token[of].astype(np.uint64) << U64(32) | own[of])
            at = runs(x >> U64(32))
            times = np.repeat(np.diff(at), np.diff(at))
            rep += np.bincount((x[times > 1] & LOW).astype(np.int64), minlength=len(names))
        hit = np.flatnonzero(rep)
        hit = hit[np.argsort(names[hit].view(np.uint64) % U64(parts), kind="stable")]
        part = (names[hit].view(np.uint64) % U64(parts)).astype(np.int64)
        at = runs(part)
        cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), *(pa.array([c[hit[i:j]].tobytes() for i, j in cut], pa.binary()) for c in (names, rep.astype(np.int32)))], ["part", "name", "rep"])
    release()


def repeated(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(name, rep): for each set, by the first half of its signature, how many of its tokens other sets hold as well (at least that many less its slack), summed over buckets of tokens in ``parts`` parts by name.

    A task sends a set once, so a text that a third of all rows hold costs one entry a task. An entry has half of the token's hash (two tokens of one
    half only let a set pass that step 2 drops) and the set's place in the task's list: 6 bytes.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, ["part"]):
            x = blobs(group, {"name": np.int64, "rep": np.int32})
            names, inverse = np.unique(x["name"], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(inverse, x["rep"]).astype(np.int64))], ["name", "rep"])

    sent = docs.select("text").mapInArrow(partial(send_sets, buckets=buckets), "bucket long, token binary, own binary, sigs binary")
    dealt = sent.repartition(partitions(docs.sparkSession, buckets, 1), "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(partial(count_repeated, parts=parts), "part long, name binary, rep binary")
    return counted.repartition(partitions(docs.sparkSession, parts, 1), "part").sortWithinPartitions("part").mapInArrow(total, "name long, rep long")


def bits_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER bits with those of the ids' hashes set; 8 MB at any number of ids."""
    parts = 64
    each = FILTER // parts

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(mix(b.column("id").to_numpy().view(np.uint64)) % U64(FILTER))
            cut = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64) * U64(each))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([(at[i:j] % U64(each)).astype(np.uint32).tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())], ["part", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            for p, body in zip(b.column("part").to_pylist(), b.column("body")):
                maps.setdefault(p, np.zeros(each, bool))[np.frombuffer(body.as_buffer(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())], ["part", "body"])

    out = np.zeros((parts, each // 8), np.uint8)
    for r in ids.select("id").mapInArrow(mark, "part int, body binary").repartition(parts, "part").mapInArrow(add, "part int, body binary").collect():
        out[r.part] = np.frombuffer(r.body, np.uint8)
    return out.ravel()


def alive_sets(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(k, sig, id, copies, n, own, tokens): the distinct sets that may have a partner other than copies; k is a number of their own, id their smallest doc_id."""
    sets = rows.where("n > 0").groupBy("sig", "name", "n", "slack").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("copies")).where("id IS NOT NULL")
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rep = repeated(docs, -(-total // BUCKET) or 1, -(-count // 100_000) or 1)
    alive = scratch.keep(sets.join(rep, "name").where("4 * (rep + slack) >= 3 * n").select("sig", "n", "id", "copies", ((F.col("n") - F.col("rep")) / F.col("n")).alias("own")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for b in slices(batch):
                keep, body = [], []
                for i, (s, g) in enumerate(zip(shingle_sets(b.column("text")), b.column("sig").to_pylist())):
                    if g not in seen and signature(s) == g:  # not so for another text of a repeated doc_id
                        seen.add(g), keep.append(i), body.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep, pa.int64())) for c in ("sig", "n", "id", "copies", "own")), pa.array(body, pa.binary())], ["sig", "n", "id", "copies", "own", "tokens"])

    sent = docs.sparkSession.sparkContext.broadcast(bits_of(alive))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            at = mix(b.column("id").to_numpy().view(np.uint64)) % U64(FILTER)
            yield b.filter(pa.array((bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1))

    # most documents have no partner: their texts need no shuffle
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").mapInArrow(sift, "id long, text string")
    found = texts.join(alive.hint("shuffle_hash"), "id").mapInArrow(fetch, "sig binary, n int, id long, copies long, own double, tokens binary").dropDuplicates(["sig"])
    out = scratch.keep(found.withColumn("k", F.monotonically_increasing_id()))
    scratch.drop(alive)
    return out


def dealt_tokens(sets: DataFrame, columns: list[str], buckets: int, expand: Callable) -> DataFrame:
    """Rows (bucket, token, columns...) of blobs: ``expand`` gives from a batch the arrays of tokens and columns, which are dealt by token."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "tokens", 8 << 20):
                cols = expand(b)
                bucket = (cols[0] % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at = runs(bucket[order])[:-1]
                cut = [*at.tolist(), len(order)]
                blobs = ([c[order[i:j]].tobytes() for i, j in zip(cut, cut[1:])] for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order[at]]), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "token", *columns])

    spark = sets.sparkSession
    out = sets.mapInArrow(deal, ", ".join(["bucket long", "token binary", *(f"{c} binary" for c in columns)]))
    return out.repartition(partitions(spark, buckets, 1), "bucket").sortWithinPartitions("bucket")


def blobs(group: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {c: [] for c in kinds}
    for b in group:
        for c, t in kinds.items():
            parts[c] += [np.frombuffer(x.as_buffer(), t) for x in b.column(c)]
    return {c: np.concatenate(x) for c, x in parts.items()}


def flat(b: pa.RecordBatch, column: str = "tokens") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a batch, the row of each, and its place in the row."""
    lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(column)]
    lens = np.array([len(x) for x in lists], np.int64)
    token = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return token, np.repeat(np.arange(len(lists)), lens), np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens)


def ordered(alive: DataFrame, buckets: int) -> DataFrame:
    """(k, tokens, heads): the tokens of a set that other sets of ``alive`` hold, the least frequent first by exact counts; the first by hash are heads."""

    def expand(b: pa.RecordBatch) -> tuple:
        token, row, _ = flat(b)
        return token, b.column("k").to_numpy()[row]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, ["bucket"]):
            x = blobs(group, {"token": np.uint64, "k": np.int64})
            order = np.argsort(x["token"], kind="stable")
            at = runs(x["token"][order])
            times = np.empty(len(order), np.uint64)
            times[order] = np.repeat(np.diff(at), np.diff(at))
            use = np.flatnonzero(times > 1)
            use = use[np.argsort(x["k"][use], kind="stable")]
            k = x["k"][use]
            at = runs(k)
            cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(k[at[:-1]]), *(pa.array([c[use[i:j]].tobytes() for i, j in cut], pa.binary()) for c in (x["token"], times))], ["k", "tokens", "times"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        size = 0
        for (k,), group in by_group(batches, ["k"]):
            x = blobs(group, {"tokens": np.uint64, "times": np.uint64})
            t = x["tokens"][np.lexsort((x["tokens"], x["times"]))]
            out[0].append(k), out[1].append(t.tobytes()), out[2].append(np.sort(t)[:HEADS].view(np.int64).tolist())
            size += len(t)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["k", "tokens", "heads"])
                out, size = [[], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["k", "tokens", "heads"])

    counted = dealt_tokens(alive.select("k", "tokens"), ["k"], buckets, expand).mapInArrow(count, "k long, tokens binary, times binary")
    dealt = counted.repartition(partitions(alive.sparkSession, buckets, 1), "k").sortWithinPartitions("k")
    return dealt.mapInArrow(order, "k long, tokens binary, heads array<long>")


def difference(own: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``own`` that t lacks, and the tokens that t adds."""
    at = np.searchsorted(own, t)
    at[at == len(own)] = 0
    there = own[at] == t
    lacks = np.ones(len(own), bool)
    lacks[at[there]] = False
    return np.flatnonzero(lacks), t[~there]


def overlapping(scratch: Scratch, alive: DataFrame, pairs: DataFrame, percent: int, per: int = 500) -> DataFrame:
    """Those pairs (a, b) whose overlap is at least ``percent`` of the union. The sets b of one a are dealt over several tasks, each with the set a first."""
    pairs = scratch.keep(pairs)
    size = pairs.groupBy("a").agg(F.expr(f"(count(1) + {per - 1}) div {per}").alias("of"))
    salted = scratch.keep(pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("of")).alias("salt")))
    need = salted.select("a", "salt", "b", F.lit(1).alias("role")).unionByName(salted.select("a", "salt", F.col("a").alias("b"), F.lit(0).alias("role")).distinct())
    sent = need.join(alive.select(F.col("k").alias("b"), "tokens"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, _), group in by_group(batches, ["a", "salt"]):
            own = None
            for part in group:
                if own is None:
                    own = np.frombuffer(part.column("tokens")[0].as_buffer(), np.uint64).copy()
                    part = part.slice(1)
                found = []
                for i, blob in zip(part.column("b").to_pylist(), part.column("tokens")):
                    t = np.frombuffer(blob.as_buffer(), np.uint64)
                    at = np.searchsorted(own, t)
                    at[at == len(own)] = 0
                    both = int((own[at] == t).sum())
                    if both and 100 * both >= percent * (len(own) + len(t) - both):
                        found.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

    n = salted.count()
    dealt = sent.repartition(partitions(scratch.spark, n, 4 * per), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.select("a", "salt", "b", "tokens").mapInArrow(compare, "a long, b long")


def leaders(scratch: Scratch, alive: DataFrame, order: DataFrame) -> DataFrame:
    """(k, n, leader) for every set.

    Of a head's list the set with the smallest share of own tokens is the candidate. A set follows the best candidate that follows nobody.
    """
    heads = scratch.keep(order.select("k", F.explode("heads").alias("token")).join(alive.select("k", F.struct("own", "k").alias("rank")), "k"))
    first = heads.groupBy("token").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = heads.join(first, "token").where("best.k <> k").select(F.col("best.k").alias("a"), F.col("k").alias("b")).distinct()
    near = scratch.keep(overlapping(scratch, alive, pairs, FOLLOW))
    ranked = near.select("a", "b").join(alive.select(F.col("k").alias("a"), F.struct("own", F.col("k").alias("a")).alias("rank")), "a")
    roots = ranked.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    follows = scratch.keep(roots.groupBy("b").agg(F.min("rank").alias("best")).select(F.col("b").alias("k"), F.col("best.a").alias("leader")))
    return scratch.keep(alive.select("k", "n").join(follows, "k", "left").select("k", "n", F.coalesce("leader", "k").alias("leader")))


def crossing(order: DataFrame, led: DataFrame, buckets: int) -> DataFrame:
    """(a, b): leaders a and sets b of other leaders such that b may link with a set that follows a, by size and position in some prefix list."""

    def expand(b: pa.RecordBatch) -> tuple:
        token, row, pos = flat(b)
        n = b.column("n").to_numpy()[row].astype(np.int64)
        own = n - np.bincount(row, minlength=b.num_rows)[row]  # tokens of its own come first in the order
        keep = own + pos < n - least_overlap(n) + 1
        row, n, left = row[keep], n[keep], (n - own - pos)[keep]
        return token[keep], b.column("k").to_numpy()[row], b.column("leader").to_numpy()[row], n.astype(np.int32), left.astype(np.int32)

    kinds = {"token": np.uint64, "k": np.int64, "leader": np.int64, "n": np.int32, "left": np.int32}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, ["bucket"]):
            x = blobs(group, kinds)
            # one entry for each leader of a list: the sizes of its sets there and the most tokens that any has left
            by = np.lexsort((x["n"], x["leader"], x["token"]))
            at = runs(x["token"][by], x["leader"][by])[:-1]
            if not len(at):
                continue
            token, leader = x["token"][by[at]], x["leader"][by[at]]
            low, high = x["n"][by[at]].astype(np.int64), x["n"][by[np.append(at[1:], len(by)) - 1]].astype(np.int64)
            left = np.maximum.reduceat(x["left"][by], at).astype(np.int64)
            several = np.repeat(np.diff(c := runs(token)) > 1, np.diff(c))
            token, leader, low, high, left = (v[several] for v in (token, leader, low, high, left))
            # members sorted by size within a list; a leader's block there runs from 3/4 of its smallest to what position and size allow
            by = np.lexsort((x["n"], x["token"]))
            t, k, own, n, rest = (x[c][by] for c in kinds)
            n, rest = n.astype(np.int64), rest.astype(np.int64)
            top = np.minimum(4 * high // 3, (7 * left - 3 * low) // 3)
            lists = np.unique(t)
            where = np.searchsorted(lists, t).astype(np.int64)
            key = (where << 32) + n
            mine = np.searchsorted(lists, token).astype(np.int64) << 32
            start = np.searchsorted(key, mine + least_overlap(low), "left")
            stop = np.maximum(start, np.searchsorted(key, mine + np.maximum(top, 0), "right"))
            found, size = [], 0
            edges = np.searchsorted(np.cumsum(stop - start), np.arange(0, int((stop - start).sum()) + 1, 1 << 20))
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(start)]):
                count = (stop - start)[i:j]
                m = np.repeat(start[i:j] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                e = np.repeat(np.arange(i, j), count)
                ok = (own[m] != leader[e]) & (7 * rest[m] >= 3 * (low[e] + n[m]))
                if ok.any():
                    found.append(np.unique(np.stack([leader[e[ok]], k[m[ok]]], 1), axis=0))
                    size += len(found[-1])
                if size > 500_000:
                    got, found, size = np.unique(np.concatenate(found), axis=0), [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
            if found:
                got = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    lists = dealt_tokens(order.select("k", "tokens").join(led, "k"), ["k", "leader", "n", "left"], buckets, expand)
    return lists.mapInArrow(match, "a long, b long").distinct()


class Block:
    """Some followers of one leader, as differences from it; ``against`` derives their links with other sets of the leader's answers."""

    def __init__(self, k: np.ndarray, diffs: list[tuple[np.ndarray, np.ndarray]], na: int):
        self.na, self.k, self.w = na, k, self.weights(diffs)
        self.added = np.unique(np.concatenate([x for _, x in diffs]))
        each = [self.ids(d, x) for d, x in diffs]
        self.cols = np.unique(np.concatenate(each))
        self.at = [np.searchsorted(self.cols, ids) for ids in each]
        self.links = np.zeros(len(k), np.int64)
        self.label = np.arange(len(k))

    @staticmethod
    def weights(diffs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([4 * len(d) + 3 * len(x) for d, x in diffs])

    def ids(self, d: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places that are lacking, then tokens that are added (those of the followers only), as numbers."""
        at = np.searchsorted(self.added, x)
        at[at == len(self.added)] = 0
        return np.concatenate([d, self.na + at[self.added[at] == x]]) if len(x) and len(self.added) else d

    def common(self, rows: np.ndarray, theirs: list[np.ndarray]) -> np.ndarray:
        """What followers and others have in common, by blocks of columns."""
        out = np.zeros((len(rows), len(theirs)), np.float32)
        pick = [self.at[r] for r in rows.tolist()]
        for lo in range(0, len(self.cols), 4096):
            f, g = (np.zeros((len(v), min(4096, len(self.cols) - lo)), np.float32) for v in (pick, theirs))
            for m, v in ((f, pick), (g, theirs)):
                for i, at in enumerate(v):
                    m[i, at[slice(*np.searchsorted(at, (lo, lo + 4096)))] - lo] = 1
            out += f @ g.T
        return out

    def against(self, k: np.ndarray, copies: np.ndarray, diffs: list[tuple[np.ndarray, np.ndarray]], edges: set[tuple[int, int]]) -> None:
        w = self.weights(diffs)
        need = self.w[:, None] + w[None, :] - self.na
        link = need <= 0
        rows, cols = np.flatnonzero(~link.all(1)), np.flatnonzero(~link.all(0))
        if len(rows):
            theirs = []
            for j in cols.tolist():
                ids = self.ids(*diffs[j])
                at = np.searchsorted(self.cols, ids)
                at[at == len(self.cols)] = 0
                theirs.append(at[self.cols[at] == ids] if len(self.cols) else at[:0])
            link[np.ix_(rows, cols)] |= 7 * self.common(rows, theirs) >= need[np.ix_(rows, cols)]
        self.links += link @ copies
        # what joins components: each linked set to one follower, and followers whose labels meet
        while True:
            low = np.where(link, self.label[:, None], len(self.k)).min(0)
            new = np.minimum(self.label, np.where(link, low[None, :], len(self.k)).min(1))
            if (new == self.label).all():
                break
            moved = np.flatnonzero(new != self.label)
            edges |= {(int(self.k[i]), int(self.k[j])) for i, j in zip(self.label[moved].tolist(), new[moved].tolist())}
            self.label = new
        edges |= {(int(self.k[r]), int(v)) for r, v in zip(low.tolist(), k.tolist()) if r < len(self.k) and self.k[r] != v}


def derived(scratch: Scratch, answers: DataFrame, led: DataFrame, alive: DataFrame) -> DataFrame:
    """(a, b, links): for each set a with answers the number of documents that it or its copies link with (b null), and edges (a, b) that connect what is linked.

    ``answers``: (a, b), a leader and the sets that it or its followers may link with, itself included.
    """
    blocks = led.groupBy("leader").agg(F.expr(f"(count(1) + {BLOCK - 1}) div {BLOCK}").alias("of"))
    facts = led.join(alive.select("k", "copies"), "k").select(F.col("k").alias("b"), "leader", "copies")
    sized = answers.join(facts, "b").join(blocks.select(F.col("leader").alias("a"), "of"), "a")
    rows = sized.select("a", "b", "copies", F.when(F.col("leader") == F.col("a"), F.pmod(F.xxhash64("b"), F.col("of"))).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("block"))
    rows = rows.withColumn("role", F.when(F.col("own") == F.col("block"), 1).otherwise(2)).drop("own")
    # the leader's set comes first, to take differences from
    first = rows.select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("copies"), "block", F.lit(0).alias("role")).distinct()
    rows = scratch.keep(rows.unionByName(first))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, ["a", "block"]):
            base: np.ndarray | None = None
            own: list[tuple] = []
            block: Block | None = None
            edges: set[tuple[int, int]] = set()

            def meet(k: np.ndarray, copies: np.ndarray, diffs: list) -> None:
                for lo in range(0, len(k), BLOCK):
                    block.against(k[lo : lo + BLOCK], copies[lo : lo + BLOCK], diffs[lo : lo + BLOCK], edges)

            def begin() -> None:
                nonlocal block
                k, copies, diffs = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]), [d for o in own for d in o[2]]
                block = Block(k, diffs, len(base))
                meet(k, copies, diffs)

            for whole in group:
                if base is None:
                    base = np.frombuffer(whole.column("tokens")[0].as_buffer(), np.uint64).copy()
                    whole = whole.slice(1)
                for part in slices(whole, "tokens", 8 << 20):
                    k, copies, role = (part.column(c).to_numpy() for c in ("b", "copies", "role"))
                    diffs = [difference(base, np.frombuffer(x.as_buffer(), np.uint64)) for x in part.column("tokens")]
                    mine = int((role == 1).sum())
                    if mine:
                        own.append((k[:mine], copies[:mine], diffs[:mine]))
                    if mine < len(k) and own:
                        if block is None:
                            begin()
                        meet(k[mine:], copies[mine:], diffs[mine:])
            if own:
                if block is None:
                    begin()
                a = block.k.tolist() + [e[0] for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(block.k) + [e[1] for e in edges], pa.int64()), pa.array(block.links.tolist() + [None] * len(edges), pa.int64())], ["a", "b", "links"])

    sent = rows.join(alive.select(F.col("k").alias("b"), "tokens"), "b")
    dealt = sent.repartition(partitions(scratch.spark, rows.count(), 2000), "a", "block").sortWithinPartitions("a", "block", "role")
    return dealt.select("a", "block", "role", "b", "copies", "tokens").mapInArrow(derive, "a long, b long, links long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents linked directly) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(signatures(docs))
    alive = alive_sets(scratch, docs, rows)
    buckets = -(-(alive.agg(F.sum("n")).first()[0] or 0) // BUCKET) or 1
    order = scratch.keep(ordered(alive, buckets))
    led = leaders(scratch, alive, order)
    cross = scratch.keep(crossing(order, led, buckets))
    # a leader's answers: its followers, what crosses, and itself if there is either
    follows = led.where("leader <> k").select(F.col("leader").alias("a"), F.col("k").alias("b"))
    pairs = follows.unionByName(cross)
    answers = scratch.keep(pairs.unionByName(pairs.select("a", F.col("a").alias("b")).distinct()))
    found = scratch.keep(derived(scratch, answers, led, alive))
    names = alive.select(F.col("k").alias("a"), "id")
    edges = found.where("b IS NOT NULL").join(names, "a").select("id", "b").join(names.select(F.col("a").alias("b"), F.col("id").alias("other")), "b").select(F.col("id").alias("a"), F.col("other").alias("b"))
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    sets = scratch.keep(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("copies")))
    # a doc_id with several texts joins their sets
    twice = some.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("doc_id")
    edges = edges.unionByName(some.join(twice, "doc_id").join(sets, "sig").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    comp = scratch.keep(components(scratch, edges))
    links = found.where("links IS NOT NULL").join(alive.select(F.col("k").alias("a"), "sig"), "a").select("sig", "links")
    known = sets.join(comp, "id", "left").select("sig", "copies", F.coalesce("comp", "id").alias("comp")).join(links, "sig", "left")
    linked = rows.select("doc_id", "n", "sig").where("n > 0").join(known, "sig", "left")
    own_links = F.coalesce("links", "copies") - F.when(F.col("doc_id").isNotNull(), 1).otherwise(0)
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), own_links.cast("long").alias("n_links")).unionByName(none)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
