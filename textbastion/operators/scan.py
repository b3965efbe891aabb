"""The cheapest-first text cascade: Unicode, phrases, decoded phrases, secrets, then a model on what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

INJECTION, SECRET, CLEAN, ERROR = "injection", "secret", "clean", "error"
#: Longest text in bytes that is accepted.
MOST_BYTES = 16 << 20


def verdict(t: Column) -> Column:
    """The whole cascade without a model: injection as given, injection in a decoding, secret as given, secret in a decoding, clean.

    Characters and secrets are looked for in the JVM. Texts that their characters don't decide go through one Arrow function for phrases and decodings.
    """
    found = T.has_invisible(t) | T.has_homoglyphs(t)
    plain = T.strip_invisible(t)
    deep = T.phrase_verdict(F.when(~found, plain))
    return F.when(found | F.coalesce(deep == INJECTION, F.lit(False)), INJECTION).when(T.has_secret(plain) | (deep == SECRET), SECRET).otherwise(CLEAN)


def scan_injection(df: DataFrame, text: str = "text", decode: bool = True, compat: bool = True) -> DataFrame:
    """Adds ``layer``: unicode, homoglyph, phrase or decoded, null where nothing is found.

    ``compat`` looks for phrases in the text with look-alike letters normalised only; without it in the text as given as well,
    which finds phrases in scripts whose letters are normalised away. Each stage in Python sees only rows that are not decided.
    """
    return _layers(df, text, decode, compat).drop("__deep")


def _layers(df: DataFrame, text: str, decode: bool, compat: bool) -> DataFrame:
    """``scan_injection`` with ``__deep``: what only a decoding shows."""
    t = F.col(text)
    first = df.withColumn("layer", F.when(T.has_invisible(t), "unicode").when(T.has_homoglyphs(t), "homoglyph"))
    plain = T.normalize_homoglyphs(T.strip_invisible(t))
    # a null input skips the automaton
    todo = F.when(F.col("layer").isNull(), plain)
    hit = F.coalesce(T.has_phrase(todo), F.lit(False))
    if not compat:
        hit = hit | F.coalesce(T.has_phrase(F.when(F.col("layer").isNull(), t)), F.lit(False))
    out = first.withColumn("layer", F.coalesce("layer", F.when(hit, "phrase")))
    if not decode:
        return out.withColumn("__deep", F.lit(None).cast("string"))
    seen = out.withColumn("__deep", T.decoded_verdict(F.when(F.col("layer").isNull(), T.strip_invisible(t))))
    return seen.withColumn("layer", F.coalesce("layer", F.when(F.col("__deep") == INJECTION, "decoded")))


def fast_scan(df: DataFrame, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ``verdict``, ``layer`` and ``reason`` to each row; a null or oversized text is an error."""
    t = F.col(text)
    bad = t.isNull() | (F.octet_length(t) > MOST_BYTES)
    out = _layers(df, text, decode, True)
    secret = T.has_secret(T.strip_invisible(t)) | F.coalesce(F.col("__deep") == SECRET, F.lit(False))
    out = out.withColumn("layer", F.coalesce("layer", F.when(secret, "secret"))).drop("__deep")
    verdict = F.when(bad, ERROR).when(F.col("layer") == "secret", SECRET).when(F.col("layer").isNotNull(), INJECTION).otherwise(CLEAN)
    return out.withColumn("verdict", verdict).withColumn("reason", F.when(F.col("verdict").isin(INJECTION, SECRET), F.concat(F.lit("found by layer "), F.col("layer"))))


def full_scan(df: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``fast_scan`` and, for the rows it leaves clean only, ``score``: (key, text) -> (key, hit boolean); a null hit is a model that failed, which counts as injection."""
    fast = fast_scan(df, text, decode)
    rest = fast.where(F.col("verdict") == CLEAN).select(key, T.strip_invisible(F.col(text)).alias("text"))
    hits = score(rest).select(key, F.coalesce("hit", F.lit(True)).alias("hit"), F.col("hit").isNull().alias("failed"))
    out = fast.join(hits, key, "left")
    model = (F.col("verdict") == CLEAN) & F.coalesce("hit", F.lit(False))
    return out.withColumn("layer", F.when(model & F.col("failed"), "no model").when(model, "model").otherwise(F.col("layer"))).withColumn("verdict", F.when(model, INJECTION).otherwise(F.col("verdict"))).drop("hit", "failed")
