"""Benchmark decontamination by spaced seeds.

Fixed masks say which of the next tokens are hashed and which are ignored. The masked hashes of all benchmark items are an index;
every document position is hashed with the same masks and looked up, which gives (item, diagonal) hits that survive substituted
tokens at ignored positions. Around each diagonal item and document are aligned token by token, and the best segment (a match
counts +1, a substitution -1 or, where that fails, -3) is verified: a document is contaminated by an item if a segment has at least ``min_match`` equal tokens (or
all tokens but a quarter, for shorter items) and at least ``min_identity`` of its tokens are equal.

Tokens are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text, so case and punctuation don't matter. Items with fewer tokens than the shortest mask are hashed as a whole. The benchmark is
processed in blocks of at most ``block_items`` items and ``block_mb`` MB of text, each block one narrow pass over the documents, so what is broadcast
is bounded however large the benchmark is; the documents are never shuffled.

Defined cases: null or empty texts have no tokens and are never contaminated; empty items match nothing; repeated items count under each item_id, null
item_ids are ignored; an empty benchmark contaminates nothing; several hits of one item in one document count once, by its best segment; rows that repeat
a doc_id are documents of their own; an empty table of documents gives no rows; an input column named hits goes. A task holds the hashes of one slice, or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _COEF, LOWER, NOT_WORD, buffers, mix, slices, table, text_column, words

MASKS = ("11111", "1101011", "11001011", "101100101", "1110000011")
U64 = np.uint64


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, and each text's first."""
    return words(*buffers(pc.utf8_lower(text_column(col))), LOWER, NOT_WORD)


class Seeds:
    """Masked hashes of the benchmark items' positions."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...] = MASKS):
        self.h, self.first = tokens(pa.array(texts, pa.large_string()))
        self.ids = np.array(ids, np.int64)
        item = np.repeat(np.arange(len(ids)), np.diff(self.first))
        shortest = min(map(len, masks))
        self.masks = [*masks, *("1" * n for n in sorted(set(np.diff(self.first).tolist())) if 0 < n < shortest)]
        keys, pos = [], []
        for m in self.masks:
            k = self.hashes(self.h, m)
            p = np.arange(len(k))
            inside = item[p] == item[p + len(m) - 1] if len(k) else np.zeros(0, bool)
            if len(m) < shortest:  # whole items only
                inside &= (np.diff(self.first)[item[p]] == len(m)) & (p == self.first[item[p]])
            keys.append(k[inside]), pos.append(p[inside])
        self.keys, self.pos = np.concatenate(keys), np.concatenate(pos)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.pos = self.keys[order], self.pos[order]
        self.item = item
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> U64(44)] = True

    @staticmethod
    def hashes(h: np.ndarray, mask: str) -> np.ndarray:
        n = len(h) - len(mask) + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, U64(int(mask, 2)), np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                out += h[i : i + n] * _COEF[i]
        return mix(out)

    def find(self, h: np.ndarray, first: np.ndarray, min_match: int, min_identity: float) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, equal tokens, segment's length, first token in the document, and behind the last) of each contaminating item."""
        where, at = [], []
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for m in self.masks:
            k = self.hashes(h, m)
            p = np.flatnonzero(self.seen[k >> U64(44)])
            if not len(p):
                continue
            p = p[row[p] == row[p + len(m) - 1]]
            lo, hi = np.searchsorted(self.keys, k[p], "left"), np.searchsorted(self.keys, k[p], "right")
            n = hi - lo
            where.append(np.repeat(p, n))
            at.append(self.pos[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        if not where:
            return []
        p, q = np.concatenate(where), np.concatenate(at)
        if not len(p):
            return []
        # one alignment per document, item and diagonal
        r, it = row[p], self.item[q]
        diagonal = (p - first[r]) - (q - self.first[it])
        cand = np.unique(np.stack([r, it, diagonal], 1), axis=0)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for r, it, d, lo, hi in self.aligned(h, first, cand, min_match):
            a, b, x = self.first[it], self.first[it + 1], first[r]
            eq = self.h[a + lo : a + hi] == h[x + d + lo : x + d + hi]
            need = min(min_match, -(-3 * int(b - a) // 4))
            for off in (1, 3):  # a mild and a strict cost of a substitution
                s = np.concatenate([[0], np.cumsum(np.where(eq, 1, -off))])
                gain = s - np.minimum.accumulate(s)
                end = int(gain.argmax())
                begin = int(np.flatnonzero(s[:end] == s[end] - gain[end])[-1]) if end else 0
                equal = int(eq[begin:end].sum())
                if end > begin and equal >= need and equal >= min_identity * (end - begin) and equal > best.get((r, it), (0,))[0]:
                    best[r, it] = (equal, end - begin, int(d + lo + begin), int(d + lo + end))
        return [(*k, *v) for k, v in best.items()]


    def aligned(self, h: np.ndarray, first: np.ndarray, cand: np.ndarray, min_match: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, diagonal, from, to) of the candidates with enough equal tokens, counted for many at a time: a phrase that many items share costs no loop for each."""
        r, it, d = cand.T
        size = self.first[it + 1] - self.first[it]
        lo, hi = np.maximum(0, -d), np.minimum(size, first[r + 1] - first[r] - d)
        need = np.minimum(min_match, -(-3 * size // 4))
        n = np.maximum(hi - lo, 0)
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
            k, part = np.repeat(np.arange(i, j), n[i:j]), n[i:j]
            at = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + lo[k]
            same = self.h[self.first[it[k]] + at] == h[first[r[k]] + d[k] + at]
            equal = np.bincount(k - i, same, j - i)
            for c in (np.flatnonzero((n[i:j] > 0) & (equal >= need[i:j])) + i).tolist():
                yield int(r[c]), int(it[c]), int(d[c]), int(lo[c]), int(hi[c])
            i = j


def blocks(bench: DataFrame, block_items: int, block_mb: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items, read one by one in item_id order, in bounded blocks."""
    ids, texts, size = [], [], 0
    for r in bench.where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id").toLocalIterator():
        ids.append(r.item_id), texts.append(r.text)
        size += len(r.text)
        if len(ids) >= block_items or size >= block_mb << 20:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_contamination(docs: DataFrame, bench: DataFrame, min_match: int = 12, min_identity: float = 0.75, block_items: int = 20_000, block_mb: int = 16) -> DataFrame:
    """All columns of ``docs`` plus (or with, where it is there) ``hits``: array of (item_id, n_equal, n_tokens, first_token, end_token), by item_id."""
    docs = docs.drop("hits")
    kind = "array<struct<item_id:bigint,n_equal:int,n_tokens:int,first_token:int,end_token:int>>"
    out = docs.select("*", F.lit(None).cast(kind).alias("hits"))
    for ids, texts in blocks(bench, block_items, block_mb):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds(ids, texts))
        out = out.mapInArrow(_probe(sent, min_match, min_identity), out.schema)
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(kind)))


def _probe(sent, min_match: int, min_identity: float):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        for batch in batches:
            for b in slices(batch):
                h, first = tokens(b.column("text"))
                i = b.schema.get_field_index("hits")
                hits = b.column(i).to_pylist()
                for r, it, equal, n, x, y in sorted(seeds.find(h, first, min_match, min_identity)):
                    hits[r] = [*(hits[r] or ()), {"item_id": int(seeds.ids[it]), "n_equal": equal, "n_tokens": n, "first_token": x, "end_token": y}]
                cols = list(b.columns)
                cols[i] = pa.array(hits, b.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return probe


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.col("hits.item_id").alias("item_ids"))
