"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index.

``fit`` learns from a bounded sample of labelled rows: at most ``max_examples`` (half toxic and half not where there are enough, chosen by the hash of
doc_id) of at most ``max_bytes`` of text together. Every term of these examples is in the space. Its weight in a text is
``(1 + log tf) * idf * relevance``; document frequencies are counted over all documents in a pass of their own, and relevance
rises with the chi-square of the term's use in toxic against clean examples from ``BASE`` (terms that tell nothing) to 1. Vectors have unit length in that space.

The inverted index is cut into blocks of similar examples. A block holds its posting lists, and for every term its largest
weight there. A document's score needs its ``k`` nearest examples: the block with the largest bound (the document's weights times the
block's maxima) comes first, and others are skipped where their bound can't reach the document's k-th best cosine; within a visited block all cosines are exact.
Votes are weighted by cosine ** 2 and by how many rows an example of its class stands for. A monotone curve, fitted to the votes
that the examples get from each other (each left out of its own), turns the share of toxic votes into a calibrated probability. Evidence: the nearest examples.

The index is bounded by the sample (about 10 bytes a term and example, 64 bytes a term). A single task builds it from the examples' terms, and the driver passes it on packed (``fit_packed``): it never
holds the examples nor the open index, only the vocabulary. It is broadcast; every document is scored in one pass, without a shuffle of texts. Words are runs of letters, digits and non-ASCII bytes with A-Z lower-cased, over the whole text.

Defined cases: null or empty text, or no known word: the curve's value at the prior; repeated labels of a document: toxic if any says so; null labels are
not learnt from; of rows that repeat a doc_id the smallest text is learnt from; without labelled rows every score is 0; documents equal in text get equal scores; ties at the k-th place all vote;
an input column that is named like one of the output goes; an empty table gives no rows. A task holds the word hashes of one slice, or of the longest text (8 bytes a byte of it).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, Scratch, buffers, slices, table, words

BLOCK = 64
#: Relevance of a term that tells nothing about the label, the z from which it is 1, and the weight of the prior in a vote.
BASE, SURE, PRIOR = 0.02, 4.0, 0.25
PARTS = 64
#: Postings of a term in a block from which its list is kept as a row of a matrix.
FULL = 4
#: Bytes of a row that carries a piece of a packed index or vocabulary.
PIECE = 4 << 20


def terms(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, off = buffers(b.column("text"))
    return words(raw, off, LOWER, NOT_WORD)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for size[i] places, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted term hashes
    weight: np.ndarray  # idf times relevance
    prior: float  # share of toxic rows among all labelled ones
    k: int
    blocks: list = field(default_factory=list)  # (terms, rows of the matrix of long lists, that matrix, starts of the short lists, examples, weights)
    maxima: np.ndarray | None = None  # terms x blocks, in steps of ``step``, rounded up
    step: float = 1 / 255
    toxic: np.ndarray | None = None
    stands: np.ndarray | None = None  # rows that an example stands for
    ids: np.ndarray | None = None
    curve: tuple = ((0.0, 1.0), (0.0, 1.0))

    def vectorise(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors as (first place of each text, terms, weights)."""
        n, v = len(first) - 1, len(self.vocabulary)
        if not v or not len(h):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.vocabulary, h)
        at[at == v] = 0
        hit = np.flatnonzero(self.vocabulary[at] == h)
        row = np.searchsorted(first, hit, "right") - 1
        key, tf = np.unique(row * v + at[hit], return_counts=True)
        return self.unit(n, key // v, key % v, tf)

    def unit(self, n: int, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.weight[term]
        norm = np.sqrt(np.bincount(row, w * w, n))
        return np.searchsorted(row, np.arange(n + 1)), term, w / np.maximum(norm, 1e-30)[row]

    def build(self, first: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        """Posting lists of the examples' vectors by block, and each term's maximum there."""
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        self.maxima = np.zeros((len(self.vocabulary), -(-n // BLOCK)), np.uint8)
        for i in range(self.maxima.shape[1]):
            x = slice(first[i * BLOCK], first[min((i + 1) * BLOCK, n)])
            order = np.argsort(term[x], kind="stable")
            t, e, v = term[x][order], row[x][order], w[x][order]
            at = np.flatnonzero(np.diff(t, prepend=-1))
            size = np.diff(np.append(at, len(t)))
            full = np.repeat(size >= FULL, size)
            place = np.where(size >= FULL, np.cumsum(size >= FULL) - 1, -1)
            matrix = np.zeros((int((size >= FULL).sum()), BLOCK), np.float32)
            matrix[np.repeat(place, size)[full], (e - i * BLOCK)[full]] = v[full]
            starts = np.append(0, np.cumsum(np.where(size >= FULL, 0, size)))
            self.blocks.append((t[at], place, matrix, starts, (e - i * BLOCK).astype(np.uint8)[~full], v.astype(np.float32)[~full]))
            if len(at):
                self.maxima[t[at], i] = np.ceil(np.maximum.reduceat(v.astype(np.float32), at) / self.step * (1 - 1e-6)).clip(0, 255)

    def block(self, i: int, first: np.ndarray, distinct: np.ndarray, which: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact cosines of some texts (terms as places in ``distinct``) with the examples of block i, through its posting lists."""
        known, column, matrix, starts, example, weight = self.blocks[i]
        place = np.searchsorted(known, distinct)
        place[place == len(known)] = 0
        held = known[place] == distinct
        size = np.diff(first)[rows]
        x = spans(first[rows], size)
        row = np.repeat(np.arange(len(rows)), size)
        hit = held[which[x]]
        x, row = x[hit], row[hit]
        at = place[which[x]]
        full = column[at] >= 0
        q = np.zeros((len(rows), len(matrix)), np.float32)
        q[row[full], column[at[full]]] = w[x[full]]
        at, x, row = at[~full], x[~full], row[~full]
        size = starts[at + 1] - starts[at]
        p = spans(starts[at], size)
        return np.bincount(np.repeat(row, size) * BLOCK + example[p], np.repeat(w[x], size) * weight[p], len(rows) * BLOCK).reshape(-1, BLOCK) + q @ matrix

    def nearest(self, first: np.ndarray, term: np.ndarray, w: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines (texts x examples) that are exact wherever they reach the text's k-th best, and -1 where skipped; and that k-th best.

        ``skip``: an example that a text has to leave out.
        """
        n, blocks = len(first) - 1, len(self.blocks)
        sims = np.full((n, blocks * BLOCK), -1.0)
        best, kth = np.zeros((n, self.k)), np.zeros(n)
        bound = np.zeros((n, blocks))
        for i in range(n):
            x = slice(first[i], first[i + 1])
            bound[i] = w[x].astype(np.float32) @ self.maxima[term[x]].astype(np.float32) * (self.step * (1 + 1e-5))
        # every text starts with the block of its largest bound; the others are swept in falling order of their bounds' sum
        lead = bound.argmax(1)
        distinct, which = np.unique(term, return_inverse=True)
        for sweep, i in [*((0, i) for i in range(blocks)), *((1, i) for i in np.argsort(-bound.sum(0), kind="stable").tolist())]:
            rows = np.flatnonzero(((lead == i) != bool(sweep)) & (bound[:, i] > np.maximum(kth - 1e-6, 0)))
            if not len(rows):
                continue
            s = self.block(i, first, distinct, which, w, rows)
            if skip is not None:
                own = np.flatnonzero(skip[rows] // BLOCK == i)
                s[own, skip[rows[own]] % BLOCK] = 0
            sims[rows, i * BLOCK : (i + 1) * BLOCK] = s
            best[rows] = -np.partition(-np.concatenate([best[rows], s], 1), self.k - 1, axis=1)[:, : self.k]
            kth[rows] = best[rows].min(1)
        return sims[:, : len(self.toxic)], kth

    def votes(self, vectors: tuple, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Share of toxic votes, and for each text the places of its three nearest examples (-1: none)."""
        n = len(vectors[0]) - 1
        near = np.full((n, 3), -1)
        if not len(self.blocks):
            return np.full(n, self.prior), near
        sims, kth = self.nearest(*vectors, skip)
        sims, kth = np.round(sims, 6), np.round(kth, 6)
        vote = np.where((sims >= kth[:, None] - 1e-6) & (sims > 0), sims**2, 0) * self.stands
        share = (vote @ self.toxic + PRIOR * self.prior) / (vote.sum(1) + PRIOR)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :3]
        near[:, : top.shape[1]] = np.where(np.take_along_axis(sims, top, 1) > 0, top, -1)
        return share, near

    def score(self, vectors: tuple) -> tuple[np.ndarray, np.ndarray]:
        share, near = self.votes(vectors)
        return np.interp(share, *self.curve), near


class Packed:
    """A pickled and compressed index, opened once in each process that scores."""

    def __init__(self, body: bytes):
        self.body, self.index = body, None

    @classmethod
    def of(cls, index: Index) -> Packed:
        return cls(zlib.compress(pickle.dumps(index, 5), 1))

    def open(self) -> Index:
        if self.index is None:
            self.index = pickle.loads(zlib.decompress(self.body))
            self.body = b""
        return self.index


def pieces(body: bytes, n: int) -> Iterator[pa.RecordBatch]:
    """``body`` in rows (at, body, n)."""
    for at, i in enumerate(range(0, max(len(body), 1), PIECE)):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([body[i : i + PIECE]], pa.binary()), pa.array([n], pa.int32())], ["at", "body", "n"])


def joined(df: DataFrame) -> tuple[bytes, int]:
    """What one task gave out in ``pieces``."""
    rows = sorted(df.collect(), key=lambda r: r.at)
    return b"".join(r.body for r in rows), rows[0].n if rows else 0


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve through the weighted means of y over pools of at least ``least`` places of x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    cuts = [0, *(i for i in range(least, len(x) - least + 1, least) if x[order[i]] > x[order[i - 1]]), len(x)]
    for i, j in zip(cuts, cuts[1:]):
        o = order[i:j]
        pools.append([float((w * x)[o].sum()), float((w * y)[o].sum()), float(w[o].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([0.0, *(p[0] / p[2] for p in pools), 1.0]), np.array([0.0, *(p[1] / p[2] for p in pools), 1.0])


def sample(docs: DataFrame, labels: DataFrame, max_examples: int, max_bytes: int) -> tuple[DataFrame | None, float]:
    """Rows (doc_id, toxic, terms, counts) of the sampled examples, and the share of toxic rows among all labelled ones; no rows where none is labelled."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    if share is None:
        return None, 0.0
    half = max_examples // 2
    of = lambda t: known.where((F.col("toxic") > 0) == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
    chosen = of(True).unionByName(of(False))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                h, first = terms(b)
                own = [np.unique(h[x:y], return_counts=True) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([x.tobytes() for x, _ in own], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in own], pa.binary())], ["doc_id", "toxic", "h", "n"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # max_examples rows at most
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.octet_length("text"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    texts = texts.withColumn("size", size).where(F.col("size") <= max_bytes)
    return texts.mapInArrow(vectors, "doc_id long, toxic int, h binary, n binary"), share


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary (sorted) is, and the number of documents. A task sends 4 bytes a term."""
    size = len(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    cuts = np.linspace(0, size + 1, PARTS + 1).astype(int).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, df, n = sent.value, np.zeros(size + 1, np.int32), 0
        for batch in batches:
            for b in slices(batch):
                h, first = terms(b)
                if size and len(h):
                    at = np.searchsorted(voc, h)
                    at[at == size] = 0
                    hit = np.flatnonzero(voc[at] == h)
                    row = np.searchsorted(first, hit, "right") - 1
                    df += np.bincount(np.unique(row * (size + 1) + at[hit]) % (size + 1), minlength=size + 1).astype(np.int32)
                n += b.num_rows
        if n:
            df[size] = n  # the last place holds the number of documents
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([df[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], ["part", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, body in zip(b.column("part").to_pylist(), b.column("body")):
                x = np.frombuffer(body.as_buffer(), np.int32).astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "body"])

    out = np.zeros(size + 1, np.int64)
    rows = docs.select("text").mapInArrow(count, "part int, body binary").repartition(PARTS, "part").mapInArrow(add, "part int, body binary")
    for r in rows.collect():  # 8 bytes a term of the sample
        out[cuts[r.part] : cuts[r.part + 1]] += np.frombuffer(r.body, np.int64)
    return out[:size], int(out[size])


def fit_packed(docs: DataFrame, labels: DataFrame, max_examples: int = 4096, max_bytes: int = 32 << 20, k: int = 15) -> Packed:
    nothing = np.zeros(0, np.uint64)
    rows, share = sample(docs, labels, max_examples, max_bytes)
    if rows is None:
        return Packed.of(learn([], np.zeros(0, bool), [], [], nothing, nothing.astype(np.int64), 0, share, k))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x, np.uint64) for b in batches for x in b.column("h").to_pylist()]
        yield from pieces(np.unique(np.concatenate(own)).tobytes() if own else b"", len(own))

    # both tasks read max_examples rows at most
    body, examples = joined(rows.coalesce(1).mapInArrow(gather, "at int, body binary, n int"))
    voc = np.frombuffer(body, np.uint64)
    if not examples:
        return Packed.of(learn([], np.zeros(0, bool), [], [], nothing, nothing.astype(np.int64), 0, share, k))
    sent = docs.sparkSession.sparkContext.broadcast((voc, *frequencies(docs, voc)))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "toxic", "n")))), key=lambda r: r[:2])
        if held:
            ids, own, toxic, times = zip(*held)
            index = learn(list(ids), np.array(toxic) > 0, [np.frombuffer(x, np.uint64) for x in own], [np.frombuffer(x, np.int32) for x in times], *sent.value, share, k)
            yield from pieces(Packed.of(index).body, len(ids))

    out = Packed(joined(rows.coalesce(1).mapInArrow(teach, "at int, body binary, n int"))[0])
    scratch.drop(rows)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4096, max_bytes: int = 32 << 20, k: int = 15) -> Index:
    """The open index, on the driver."""
    return fit_packed(docs, labels, max_examples, max_bytes, k).open()


def learn(ids: list[int], y: np.ndarray, own: list[np.ndarray], times: list[np.ndarray], voc: np.ndarray, df: np.ndarray, total: int, share: float, k: int) -> Index:
    """The index of examples with these ids, labels, terms and counts; ``df`` of ``total`` documents hold a term, ``share`` of all labelled rows are toxic."""
    if not ids:
        return Index(voc, np.zeros(len(voc)), share, k, curve=((0.0, 1.0), (share, share)))
    term = np.searchsorted(voc, np.concatenate(own))
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    n1, n0 = (np.bincount(term[c[doc]], minlength=len(voc)).astype(np.float64) for c in (y, ~y))
    m1, m0 = float(y.sum()), float((~y).sum())
    # chi-square of use by class, with Yates' correction
    n, m = n1 + n0, m1 + m0
    off = np.maximum(np.abs(n1 * m0 - n0 * m1) - m / 2, 0)
    z = np.where(n1 * m0 > n0 * m1, np.sqrt(m * off**2 / np.maximum(n * (m - n) * m1 * m0, 1e-9)), 0)
    relevance = BASE + (1 - BASE) * np.minimum(z / SURE, 1) ** 2
    index = Index(voc, np.log((total + 1) / (df + 0.5)) * relevance, share, k)
    first, term, w = index.unit(len(ids), doc, term, np.concatenate(times))
    # similar examples share blocks: by their strongest term, then their class
    top = np.zeros(len(ids), np.int64)
    by = np.lexsort((w, doc))
    top[doc[by]] = term[by]
    order = np.lexsort((y, top))
    size = np.diff(first)[order]
    x = spans(first[:-1][order], size)
    vectors = np.append(0, np.cumsum(size)), term[x], w[x]
    index.build(*vectors)
    index.toxic = y[order].astype(np.float64)
    # the sample holds the classes half and half: a clean example stands for more rows
    index.stands = np.where(index.toxic > 0, 1.0, (1 - share) / share * m1 / m0 if m0 and m1 and share else 1.0)
    index.ids = np.array(ids, np.int64)[order]
    got = np.concatenate([index.votes((vectors[0][i : j + 1] - vectors[0][i], *(v[vectors[0][i] : vectors[0][j]] for v in vectors[1:])), np.arange(i, j))[0] for i in range(0, len(ids), 256) for j in [min(i + 256, len(ids))]])
    index.curve = monotone(got, index.toxic, index.stands)
    return index


def score(docs: DataFrame, index: Index | Packed) -> DataFrame:
    """All columns of ``docs`` plus (or with, where they are there) toxicity (double) and evidence (doc_ids of the nearest examples)."""
    docs = docs.drop("toxicity", "evidence")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(index if isinstance(index, Packed) else Packed.of(index))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value.open()
        for batch in batches:
            for b in slices(batch):
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    s, near = ix.score(ix.vectorise(*terms(part)))
                    ids = [[int(ix.ids[j]) for j in row if j >= 0] for row in near.tolist()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.clip(s, 0, 1)), pa.array(ids, pa.list_(pa.int64()))], [*names, "toxicity", "evidence"])

    return docs.mapInArrow(judge, docs.select("*", F.lit(0.0).alias("toxicity"), F.lit(None).cast("array<long>").alias("evidence")).schema)


def fold(column: str, of: int):
    """crc32 of the id as text mod ``of``; a null id is in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit_packed(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = score(docs, index)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "evidence")
