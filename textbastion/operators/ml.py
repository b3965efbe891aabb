"""Chunking, scoring and the ensemble. Models are pluggable: a scorer maps a column of chunks to a column of probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

CHUNK, STEP, HEAD, TAIL = 256, 231, 512, 512


def _floor(raw: bytes, i: int) -> int:
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i


def split_chunks(t: str) -> list[str]:
    """Windows of 256 bytes every 231, both ends moved back to a character; blank ones drop out unless the text fits in one."""
    raw = t.encode()
    if len(raw) <= CHUNK:
        return [t]
    out, start = [], 0
    while start < len(raw):
        end = _floor(raw, min(start + CHUNK, len(raw)))
        piece = raw[start:end].decode()
        if piece.strip():
            out.append(piece)
        nxt = _floor(raw, min(start + STEP, len(raw)))
        start = nxt if nxt > start else end
    return out


@F.pandas_udf(ArrayType(StringType()))
def chunks_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else split_chunks(t))


def join_ends(t: str) -> str | None:
    """First and last 512 bytes of texts above 1024, both cuts moved back to a character."""
    raw = t.encode()
    if len(raw) <= HEAD + TAIL:
        return None
    return raw[: _floor(raw, HEAD)].decode() + " " + raw[_floor(raw, len(raw) - TAIL) :].decode()


@F.pandas_udf(StringType())
def head_tail_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else join_ends(t))


def injection_probability(logits: Column) -> Column:
    """One less the softmax of class 0; fewer than two logits give 0."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.when(F.size(logits) < 2, F.lit(0.0)).otherwise(1 - e[0] / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


@dataclass(frozen=True)
class Model:
    name: str
    score: Callable[[Column], Column]
    threshold: float | None = None


def keyword_score(weight: float) -> Callable[[Column], Column]:
    """A closed-form stand-in for a model: the share of marker words, by weight, capped at 1."""

    def score(t: Column) -> Column:
        low = F.lower(t)
        n = sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in ("ignore", "instructions", "system", "prompt")), F.lit(0.0))
        return F.least(F.lit(1.0), n * weight).cast("float")

    return score


STUBS = [Model("narrow", keyword_score(0.2)), Model("wide", keyword_score(0.4), 0.75)]


def onnx_scorer(path: str, encode: Callable[[str], tuple[list[int], list[int]]], batch: int = 32) -> Callable[[Column], Column]:
    """Scores by an ONNX classifier, loaded once per worker; ``batch`` chunks go through it at a time."""

    @F.pandas_udf("float")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        names = [i.name for i in session.get_inputs()]
        for s in batches:
            out = []
            for lo in range(0, len(s), batch):
                both = [encode(t) for t in s.iloc[lo : lo + batch]]
                width = max(len(ids) for ids, _ in both)
                # short pieces are filled up; their mask leaves the filling out
                ids, mask = (np.array([list(x[i]) + [0] * (width - len(x[i])) for x in both], np.int64) for i in (0, 1))
                z = session.run(None, dict(zip(names, (ids, mask))))[0]
                e = np.exp(z - z.max(1, keepdims=True))
                out += (1 - e[:, 0] / e.sum(1)).tolist() if z.shape[1] > 1 else [0.0] * len(z)
            yield pd.Series(out, dtype="float32")

    return lambda t: score(t)


def score_chunks(df: DataFrame, key: str, models: list[Model], text: str = "text") -> DataFrame:
    """(key, model, threshold, chunk_no, score): all chunks and the head-and-tail piece, by each model.

    The models are a handful of literals, exploded beside the chunks, so no join and no shuffle is needed.
    """
    t = F.col(text)
    parts, ends = chunks_udf(t), head_tail_udf(t)
    pieces = df.select(key, F.concat(parts, F.coalesce(F.filter(F.array(ends), lambda x: x.isNotNull()), F.array().cast("array<string>"))).alias("c"))
    rows = pieces.select(key, F.posexplode("c").alias("chunk_no", "chunk"))
    scored = rows.select(key, "chunk_no", F.explode(F.array(*(F.struct(F.lit(m.name).alias("model"), F.lit(m.threshold).cast("float").alias("threshold"), m.score(F.col("chunk")).alias("score")) for m in models))).alias("m"))
    return scored.select(key, "m.model", "m.threshold", "chunk_no", "m.score")


def ensemble(scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, hit, best): a hit if any chunk reaches its model's threshold, or the request's where the model has none; one shuffle."""
    t = F.coalesce("threshold", F.lit(threshold).cast("float"))
    return scores.groupBy(key).agg(F.bool_or(F.col("score") >= t).alias("hit"), F.max("score").alias("best"))
