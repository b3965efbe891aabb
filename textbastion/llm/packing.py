"""Best-fit packing with a linear grouping scheme.

Documents become token ids (a byte-level BPE file read by ``tokenizers``) and an end id; only documents longer than a sequence
are cut, into full pieces of which the first may be shorter. What has to be packed is then a histogram of at most ``capacity``
lengths, so the plan is made on the driver from bounded data, whatever the size of the corpus:

1. lengths above ``capacity // 8`` are large; sorted by length they form groups of equal cardinality, and each group's
   lengths are rounded up to its longest (the linear grouping scheme), which leaves few sizes;
2. configurations of these sizes are chosen one at a time: the one that holds the largest size left and fills a sequence
   best (a knapsack over the sizes), used as often as the groups can supply it;
3. the slots of a configuration take actual documents of their groups, run by run of equal lengths, which frees the
   rounding again; 4. small ones go, longest first, into the smallest gap that holds them (best fit).

All steps work on runs (length, ranks, sequences), not single documents. The plan is a table of runs that is broadcast; its size is
bounded by groups, lengths and slots. Every piece finds its sequence by its rank among the pieces of its length, and ranks come
from per-partition counts, not from a sort.

Defined cases: null text is empty and packs as the end id alone; repeated rows are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table

END = 0


# ---------------------------------------------------------------- tokens

class _Chunks(dict):
    """Chunk -> place in the encoder's pool; -1 for a chunk at which a text can't be split."""

    def __init__(self, prefix: str, owner: Encoder):
        super().__init__()
        self.prefix, self.owner = prefix, owner

    def __missing__(self, s: str) -> int:
        if not s or s[0].isspace() or s[-1].isspace() or any(x in s for x in self.owner.special):
            self[s] = -1
            return -1
        at = self[s] = self.owner.add(self.prefix + s)
        return at


class Encoder:
    """Ids of whole texts, by way of a memo of the chunks between single spaces and line ends.

    Byte-level pre-tokenisation never joins text across a single space or line end that has other than white space on both
    sides, so such a text is the chain of its chunks; every other text is encoded as a whole. The memo starts anew at
    ``room`` entries, which bounds a worker's memory. New chunks go through ``tiktoken`` with the ranks of the same file,
    which merges alike where ids are in the order of merges (checked when the file is read), else through ``tokenizers``.
    """

    def __init__(self, path: str, room: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = _ranks(path)
        self.room = room
        self.reset()

    def reset(self) -> None:
        self.pending: list[str] = []
        self.n = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int64)
        self.lead, self.spaced = _Chunks("", self), _Chunks(" ", self)
        # two fixed entries: the line end, and the end of a document
        self.line, self.end, self.n = 0, 1, 2
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.pool[: len(line) + 1] = [*line, END]
        self.start[1], self.len[:2], self.used = len(line), [len(line), 1], len(line) + 1

    def add(self, s: str) -> int:
        self.pending.append(s)
        self.n += 1
        return self.n - 1

    def _flush(self) -> None:
        if not self.pending:
            return
        first = self.n - len(self.pending)
        lens, flat = self._ids(self.pending)
        while self.n > len(self.len):
            self.start, self.len = np.resize(self.start, 2 * len(self.start)), np.resize(self.len, 2 * len(self.len))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.len[first : self.n] = lens
        self.start[first : self.n] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.pending = []

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, one after the other, of chunks without line ends."""
        if self.fast:
            # a line end is a token of its own between chunks that neither begin nor end with white space but for one blank
            ids = self.fast.encode_to_numpy("\n".join(chunks), disallowed_special=()).astype(np.int32)
            cut = np.flatnonzero(ids == self.pool[0])
            if len(cut) == len(chunks) - 1:
                return np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1, np.delete(ids, cut)
        got = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int64, len(got)), np.fromiter((x for i in got for x in i), np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and offsets into them."""
        if self.n > self.room:
            self.reset()
        lead, spaced, line = self.lead.__getitem__, self.spaced.__getitem__, self.line
        flat: list[int] = []
        ends, whole = [], {}
        for r, t in enumerate(texts):
            if t:
                at = len(flat)
                for part in t.split("\n"):
                    head, *rest = part.split(" ")
                    flat.append(lead(head))
                    flat.extend(map(spaced, rest))
                    flat.append(line)
                flat.pop()
                if -1 in flat[at:]:
                    del flat[at:]
                    whole[r] = t
            flat.append(self.end)
            ends.append(len(flat))
        self._flush()
        at = np.array(flat, np.int64)
        lens = self.len[at]
        total = np.cumsum(lens)
        ids = self.pool[np.repeat(self.start[at] - total + lens, lens) + np.arange(int(total[-1]) if len(total) else 0)]
        off = np.concatenate([[0], total[np.array(ends, np.int64) - 1]]) if ends else np.zeros(1, np.int64)
        if whole:
            parts = [ids[a:b] for a, b in zip(off[:-1], off[1:])]
            for r, e in zip(whole, self.tok.encode_batch_fast(list(whole.values()), add_special_tokens=False)):
                parts[r] = np.array([*e.ids, END], np.int32)
            ids = np.concatenate(parts)
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, off


def _ranks(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level BPE file whose ids follow its merges, else None."""
    import public_tokenizers
    import tiktoken

    spec = json.loads(Path(path).read_text())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    at = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if any(a >= b for a, b in zip(ids, ids[1:])) or len(model["vocab"]) - len(added & model["vocab"].keys()) != len(merged) + 256:
        return None
    ranks = {bytes(at[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, capacity: int, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, at [, ids]): ``at`` counts pieces of a length within partition ``part``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for b in slices(batch, most=1 << 19):
                ids, off = enc.encode([t or "" for t in b.column("text").to_pylist()])
                n = np.diff(off)
                k = -(-n // capacity)  # pieces of each document
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                head = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                lo = off[row] + start
                le = ids.astype("<u4")
                crc = [zlib.crc32(le[a:z]) for a, z in zip(lo.tolist(), (lo + length).tolist())]
                order = np.argsort(length, kind="stable")
                s = length[order]
                at = np.empty(len(s), np.int64)
                at[order] = np.arange(len(s)) - np.searchsorted(s, s) + seen[s]
                np.add.at(seen, length, 1)
                cols = [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int64)), pa.array(at)]
                if with_ids:
                    cols.append(pa.array([ids[a:z] for a, z in zip(lo.tolist(), (lo + length).tolist())], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, at long" + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- plan

class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, count)

    def place(self, length: int, rank: int, count: int, first: int, used: int) -> None:
        self.runs.append((length, rank, count, first, used))

    def free(self, gap: int, first: int, count: int) -> None:
        if gap:
            self.gaps.setdefault(gap, []).append((first, count))


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size: the first (largest) left at least once, then the fullest, with at most ``left`` of each."""
    use = [0] * len(sizes)
    top = next(i for i, n in enumerate(left) if n)
    use[top] = 1
    room = capacity - sizes[top]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps = []
    for i in range(top, len(sizes)):
        n = left[i] - (i == top)
        for _ in range(min(n, room // sizes[i])):
            new = np.zeros_like(reach)
            new[sizes[i] :] = reach[: len(reach) - sizes[i]]
            new &= ~reach
            if not new.any():
                break
            steps.append((i, new))
            reach = reach | new
    at = int(np.flatnonzero(reach)[-1])
    for i, new in reversed(steps):
        if at and new[at]:
            use[i] += 1
            at -= sizes[i]
    return use


def plan(counts: dict[int, int], capacity: int, groups: int = 96) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset), sorted by length and rank; and the number of sequences."""
    p = _Plan(capacity)
    small = capacity // 8
    large = sorted((n for n in counts if small < n < capacity and counts[n]), reverse=True)
    if counts.get(capacity):
        p.place(capacity, 0, counts[capacity], 0, 0)
        p.bins = counts[capacity]
    total = sum(counts[n] for n in large)
    # groups of equal cardinality; a group may begin within a length
    queue: list[list[list[int]]] = []  # of each group: [length, first rank, count]
    if total:
        per, room = -(-total // groups), 0
        for n in large:
            rank = 0
            while rank < counts[n]:
                if not room:
                    queue.append([])
                    room = per
                take = min(room, counts[n] - rank)
                queue[-1].append([n, rank, take])
                rank, room = rank + take, room - take
    sizes = [g[0][0] for g in queue]
    left = [sum(r[2] for r in g) for g in queue]
    while any(left):
        use = _configuration(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, use) if u)
        parts = [[p.bins, times, 0]]
        p.bins += times
        for g, u in enumerate(use):
            for _ in range(u):
                nxt = []
                for first, count, used in parts:
                    while count:
                        run = queue[g][0]
                        k = min(count, run[2])
                        p.place(run[0], run[1], k, first, used)
                        nxt.append([first, k, used + run[0]])
                        first, count = first + k, count - k
                        run[1], run[2] = run[1] + k, run[2] - k
                        if not run[2]:
                            queue[g].pop(0)
                parts = nxt
            left[g] -= u * times
        for first, count, used in parts:
            p.free(capacity - used, first, count)
    for n in range(min(small, capacity - 1), 0, -1):
        rest, rank = counts.get(n, 0), 0
        while rest:
            fit = min((g for g in p.gaps if g >= n), default=0)
            if not fit:
                new = -(-rest * n // capacity)
                p.free(capacity, p.bins, new)
                p.bins += new
                continue
            first, count = p.gaps[fit].pop()
            if not p.gaps[fit]:
                del p.gaps[fit]
            k = min(rest, count)
            p.place(n, rank, k, first, capacity - fit)
            p.free(fit - n, first, k)
            if k < count:
                p.free(fit, first + k, count - k)
            rest, rank = rest - k, rank + k
    runs = np.array(sorted(p.runs), np.int64).reshape(-1, 5)
    return runs, p.bins


def ranked(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """``rank`` of each piece among all of its length, from the counts (part, length, n)."""
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    return kept.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, groups: int = 96, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.keep(pieces(docs, capacity, vocabulary or default_vocabulary(), with_ids))
    counts = scratch.keep(kept.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    # at most ``capacity`` rows
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(hist, capacity, groups)
    sent = docs.sparkSession.sparkContext.broadcast(runs)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        wide = np.int64(1 << 44)
        keys = r[:, 0] * wide + r[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * wide + rank, "right") - 1
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[i, 3] + rank - r[i, 1]), pa.array(r[i, 4])], [*names, "sequence_id", "offset"])

    names = [c for c in kept.columns if c not in ("part", "at")]
    schema = kept.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked(kept, counts).mapInArrow(assign, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
