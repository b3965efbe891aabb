"""Language ID by multilingual mixture inference.

``fit`` counts letter n-grams (one to three characters' bytes within words, hashed to ``BUCKETS`` buckets) for every language over
all documents with a language: one pass, sums by (language, bucket) with a map-side part; what reaches the driver is bounded
by ``max_langs`` x buckets. A document is a mixture of languages over its n-grams: expectation-maximisation estimates the proportions,
first for all languages, then for the sets of the 1, 2, ... largest; the set with the best penalised log-likelihood (BIC)
stays. The predicted language has the largest proportion, which is the score.

Documents are processed in slices of about 1 MB of text (a longer one alone); the EM runs for all documents of a slice at once, and each stops for itself.

Defined cases: null text and text without a letter: ``und`` with score 0; rows with a null or empty language are not learnt
from; with no learnt language every text is ``und``; equal texts get equal answers, in whatever slice they come; an empty table gives no rows; of input
columns with the names of the output the output's stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buffers, slices, table
from .toxicity import fold

BITS = 14
BUCKETS = 1 << BITS
#: Byte classes: A-Z as a-z, letters and bytes from 128 as they are, anything else a word boundary (0).
_CLASS = np.zeros(256, np.uint32)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys row * BUCKETS + bucket of the texts' n-grams, one per occurrence group, and the counts."""
    raw, off = buffers(b.column("text"))
    n = len(off) - 1
    size = max(len(raw) + n + 2, 5)
    # a boundary before each text and after the last
    at = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off)) + 1
    c = np.zeros(size, np.uint32)
    c[at] = _CLASS[raw]
    row = np.zeros(size, np.int64)
    row[at] = np.repeat(np.arange(n), np.diff(off))
    out = []
    # windows of 4 and 6 bytes within or at the edge of words; the first byte of a window decides its row
    for k, mult in ((3, 0x9E3779B1), (5, 0x85EBCA6B)):
        h = np.zeros(size - k + 1, np.uint32)
        for i in range(k):
            h = h * np.uint32(0x01000193) + c[i : size - k + 1 + i]
        h = (h * np.uint32(mult)) >> np.uint32(32 - BITS)
        inner = c[1 : size - k + 2] > 0
        for i in range(2, k - 1):
            inner &= c[i : size - k + 1 + i] > 0
        j = np.flatnonzero(inner)
        out.append(row[j + 1] * BUCKETS + h[j])
    keys, counts = np.unique(np.concatenate(out), return_counts=True)
    return keys, counts


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray  # buckets x languages

    def infer(self, keys: np.ndarray, counts: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
        """Proportions (documents x languages) of the selected language set."""
        k = len(self.langs)
        best = np.zeros((n, k))
        value = np.full(n, -np.inf)
        x = _Slice(self, keys, counts, n)
        alone = x.sums(x.w[:, None] * np.log(x.lik))
        best[x.docs, np.argmax(alone, axis=1)] = 1
        value[x.docs] = x.loglik(best[x.docs])
        if k > 1 and len(x.docs):
            free = np.zeros((n, k))
            free[x.docs] = x.em(np.full((len(x.docs), k), 1.0 / k), rounds)
            rank = np.argsort(np.argsort(-free, axis=1, kind="stable"), axis=1, kind="stable")
            for size in range(2, k + 1):
                d = x.docs
                pi = np.where(rank[d] < size, np.maximum(free[d], 1e-6), 0)
                pi = x.em(pi / pi.sum(1, keepdims=True), max(2, rounds // 3))
                got = x.loglik(pi) - 0.5 * (size - 1) * np.log(np.maximum(x.total, 1))
                better = got > value[d]
                best[d[better]], value[d[better]] = pi[better], got[better]
                # a document whose larger set is no better is done, whatever the others of the slice do
                if not better.any():
                    break
                x.keep(better)
        return best


class _Slice:
    """Likelihoods of the n-grams of some documents, sorted by document, and the documents that have any."""

    def __init__(self, model: Model, keys: np.ndarray, counts: np.ndarray, n: int):
        row = keys // BUCKETS
        self.docs, self.row = np.unique(row, return_inverse=True)
        self.lik = model.prob[keys % BUCKETS]
        # windows overlap: about a fifth of them is independent evidence
        self.w = (counts / 5.0).astype(np.float32)
        self._index()

    def _index(self) -> None:
        self.starts = np.searchsorted(self.row, np.arange(len(self.docs)))
        self.total = np.add.reduceat(self.w, self.starts) if len(self.docs) else np.zeros(0, np.float32)

    def keep(self, some: np.ndarray) -> None:
        own = some[self.row]
        self.row, self.lik, self.w = (np.cumsum(some) - 1)[self.row[own]], self.lik[own], self.w[own]
        self.docs = self.docs[some]
        self._index()

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=0).astype(np.float64) if len(self.docs) else np.zeros((0, *x.shape[1:]))

    def em(self, pi: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            r = self.lik * pi[self.row].astype(np.float32)
            r *= (self.w / np.maximum(r.sum(1), 1e-30))[:, None]
            pi = self.sums(r) / np.maximum(self.total, 1e-30)[:, None]
        return pi

    def loglik(self, pi: np.ndarray) -> np.ndarray:
        return self.sums(self.w * np.log(np.maximum((self.lik * pi[self.row].astype(np.float32)).sum(1), 1e-30)))


def fit(docs: DataFrame, max_langs: int = 1000) -> Model:
    """Model of all (text, lang) rows with a language. More than ``max_langs`` languages are an error."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch):
                langs = b.column("lang").to_pylist()
                keys, n = grams(b)
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])[keys // BUCKETS]
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS)
                    sums[lang] += np.bincount(keys[own] % BUCKETS, n[own], BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], ["lang", "bucket", "n"])

    given = docs.select("text", "lang").where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
    rows = Scratch(docs.sparkSession).keep(given.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = rows.select("lang").distinct().limit(max_langs + 1).count()
    if langs > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs if the executors have 64 KB for each")
    got = rows.toPandas()  # max_langs x buckets at most
    langs = sorted(got.lang.unique())
    counts = np.full((BUCKETS, len(langs)), 0.5)
    for i, lang in enumerate(langs):
        own = got[got.lang == lang]
        counts[own.bucket.to_numpy(), i] += own.n.to_numpy()
    return Model(langs, (counts / counts.sum(0)).astype(np.float32) if langs else counts)


def _letter(t: str | None) -> bool:
    return bool(t) and (t.isalpha() or any(map(str.isalpha, t)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus (or with, where they are there) lang_pred, score and proportions (map of language to share)."""
    docs = docs.drop("lang_pred", "score", "proportions")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for b in slices(batch):
                known = np.array([_letter(t) for t in b.column("text").to_pylist()]) & bool(m.langs)
                pred, score, mixed = ["und"] * b.num_rows, np.zeros(b.num_rows), [[] for _ in known]
                if m.langs:
                    pi = m.infer(*grams(b), b.num_rows)
                    for i in np.flatnonzero(known).tolist():
                        j = int(pi[i].argmax())
                        pred[i], score[i] = m.langs[j], min(1.0, float(pi[i, j]))
                        mixed[i] = [(m.langs[k], float(pi[i, k])) for k in np.flatnonzero(pi[i] > 0.001)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "proportions"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,double>").alias("proportions")).schema
    return docs.mapInArrow(judge, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
