"""Column builders on text: Unicode checks, phrases, secrets, decoders, entropy. JVM-side unless said otherwise."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import catalogs as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(t: Column) -> Column:
    return F.translate(t, UPPER, LOWER)


def has_invisible(t: Column) -> Column:
    """Any private-use or unassigned character, or three format characters, after one leading byte-order mark is dropped."""
    body = F.regexp_replace(t, "^\\x{FEFF}", "")
    return body.rlike("[\\p{Co}\\p{Cn}]") | (F.regexp_count(body, F.lit("\\p{Cf}")) >= 3)


def has_homoglyphs(t: Column) -> Column:
    return t.rlike(f"[{C.HOMOGLYPHS_FROM}{C.BIDI_CONTROLS}]") & t.rlike("[A-Za-z]")


def strip_invisible(t: Column) -> Column:
    return F.regexp_replace(t, "[\\p{Cf}\\p{Co}\\p{Cn}]", "")


def normalize_homoglyphs(t: Column) -> Column:
    return F.translate(t, C.HOMOGLYPHS_FROM + C.BIDI_CONTROLS, C.HOMOGLYPHS_TO)


def collapse_whitespace(t: Column) -> Column:
    return F.regexp_replace(t, "(?U)\\s+", " ")


def contains_any(t: Column, values: list[str]) -> Column:
    """An alternation; literals only, so it compiles once a task."""
    return t.rlike("|".join(re.escape(v).replace("/", "\\/") for v in values))


def has_phrase_native(t: Column, phrases: list[str] | None = None) -> Column:
    # the array binds the folded text, which would be computed anew for each phrase otherwise
    return F.exists(F.array(ascii_lower(t)), lambda low: contains_any(low, phrases or C.INJECTION_PHRASES))


_AUTOMATA: dict[tuple[str, ...], object] = {}


def _automaton(phrases: tuple[str, ...]):
    if phrases not in _AUTOMATA:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in phrases:
            a.add_word(fold(p), p)
        a.make_automaton()
        _AUTOMATA[phrases] = a
    return _AUTOMATA[phrases]


def fold(t: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return t.lower() if t.isascii() else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def has_phrase(t: Column, phrases: list[str] | None = None) -> Column:
    """One pass of an automaton over Arrow batches; faster than an alternation from about ten phrases on. Null stays null."""
    wanted = tuple(phrases or C.INJECTION_PHRASES)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton(wanted)
        for s in batches:
            yield pd.Series([None if x is None else next(a.iter(fold(x)), None) is not None for x in s], dtype="object")

    return found(t)


def secret_regex(own: bool = True, add: list[str] = (), remove: list[str] = ()) -> str:
    known = [*C.SECRET_PATTERNS.values(), *(C.OWN_SECRET_PATTERNS.values() if own else ())]
    # an alternative's own flag must not leak into the next
    return "|".join(re.sub(r"^\(\?i\)(.*)$", r"(?i:\1)", p) for p in C.with_overrides(known, list(add), list(remove)))


def has_secret(t: Column) -> Column:
    return t.rlike(secret_regex())


def secret_kinds(t: Column) -> Column:
    """Names of the patterns that match, in catalog order."""
    known = C.SECRET_PATTERNS | C.OWN_SECRET_PATTERNS
    return F.filter(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in known.items())), lambda x: x.isNotNull())


# ---------------------------------------------------------------- decoders, one level

MOST = 4096


def _utf8(b: Column) -> Column:
    return F.try_validate_utf8(b.cast("string"))


def decode_base64(t: Column) -> Column:
    """Strict standard or URL-safe alphabet (not mixed), white space dropped, 8 characters or more, 4096 bytes at most, valid UTF-8."""
    s = F.regexp_replace(t, "(?U)\\s", "")
    plain = F.regexp_replace(F.when(s.rlike("^[A-Za-z0-9+/]+={0,2}$"), s).when(s.rlike("^[A-Za-z0-9_-]+={0,2}$"), F.translate(s, "-_", "+/")), "=", "")
    n = F.length(plain)
    ok = (F.length(s) >= 8) & (n % 4 != 1) & (~s.contains("=") | (F.length(s) % 4 == 0))
    # bits behind the last byte have to be zero
    tail = F.when(n % 4 == 2, plain.rlike("[AQgw]$")).when(n % 4 == 3, plain.rlike("[AEIMQUYcgkosw048]$")).otherwise(True)
    b = F.try_to_binary(F.rpad(plain, ((n + 3) / 4).cast("int") * 4, "="), F.lit("base64"))
    return F.when(ok & tail & (F.octet_length(b) <= MOST), _utf8(b))


def decode_hex(t: Column) -> Column:
    """Optional 0x, white space dropped, even length of 8 or more, 4096 bytes at most, valid UTF-8."""
    s = F.regexp_replace(F.regexp_replace(F.trim(t), "^0[xX]", ""), "(?U)\\s", "")
    b = F.try_to_binary(F.when(s.rlike("^[0-9A-Fa-f]+$") & (F.length(s) >= 8) & (F.length(s) % 2 == 0), s), F.lit("hex"))
    return F.when(F.octet_length(b) <= MOST, _utf8(b))


def decode_url(t: Column) -> Column:
    """Percent escapes where there are three or more %; plus signs stay; null unless it changes the text and every escape is whole."""
    d = F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B")))
    return F.when((F.regexp_count(t, F.lit("%")) >= 3) & (F.octet_length(d) <= MOST) & (d != t), d)


def rot13(t: Column) -> Column:
    return F.translate(t, UPPER + LOWER, UPPER[13:] + UPPER[:13] + LOWER[13:] + LOWER[:13])


def decode_rot13(t: Column) -> Column:
    """Where there are 8 ASCII letters and they make up half of the bytes."""
    n = F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when((n >= 8) & (n * 2 >= F.octet_length(t)), rot13(t))


@F.pandas_udf(StringType())
def decode_html(s: pd.Series) -> pd.Series:
    """Entities that end in a semicolon; null unless it changes the text."""
    import html

    def one(t: str | None) -> str | None:
        if t is None or "&" not in t or ";" not in t:
            return None
        out = re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]), t)
        return out if out != t and len(out.encode()) <= MOST else None

    return s.map(one)


def entropy(t: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes in bits, 0 for the empty text."""
    hexed = F.hex(F.encode(t, "UTF-8"))
    n = F.octet_length(t)
    bytes_ = F.filter(F.split(F.regexp_replace(hexed, "(..)", "$1,"), ","), lambda x: x != "")
    counts = F.transform(F.array_distinct(bytes_), lambda b: F.size(F.filter(bytes_, lambda x: x == b)).cast("double") / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


# ---------------------------------------------------------------- decode variants, exact (Arrow)

WINDOW, MARK = 32, 4.5


def _entropy(b: bytes) -> float:
    from collections import Counter
    from math import log2

    n = len(b)
    return -sum(c / n * log2(c / n) for c in Counter(b).values()) if n else 0.0


#: Distinct bytes that a window needs at least for its entropy to reach the mark.
_LEAST = 23
_STEPS = np.diff([c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)])


def _hot_windows(text: str) -> np.ndarray:
    """Starts of the windows whose entropy reaches the mark; linear in the text but for windows that come close."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) - WINDOW + 1
    order = np.argsort(points, kind="stable")
    before = np.full(len(points), -1)
    same = points[order[1:]] == points[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a character repeats one within all windows that hold both
    j = np.flatnonzero((before >= 0) & (np.arange(len(points)) - before < WINDOW))
    step = np.bincount(np.maximum(j - WINDOW + 1, 0), minlength=len(points) + 2) - np.bincount(before[j] + 1, minlength=len(points) + 2)
    distinct = WINDOW - np.cumsum(step)[:n]
    wide = np.cumsum(np.concatenate([[0], (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)]))
    # bytes that a window adds to its distinct characters: no more than the leading bytes that the text has
    leading = sum(len(np.unique(points[points > least] >> shift)) for least, shift in ((0x7F, 6), (0x7FF, 12), (0xFFFF, 18)))
    close = np.flatnonzero(distinct + np.minimum(wide[WINDOW:] - wide[:-WINDOW], leading) >= _LEAST)
    ascii_only = wide[close + WINDOW] == wide[close]
    hot = [i for i in close[~ascii_only].tolist() if _entropy(text[i : i + WINDOW].encode("utf-8", "surrogatepass")) >= MARK]
    plain = close[ascii_only]
    for lo in range(0, len(plain), 1 << 14):
        at = plain[lo : lo + (1 << 14)]
        rows = np.sort(points[at[:, None] + np.arange(WINDOW)].astype(np.uint8), axis=1)
        total, again = np.zeros(len(at)), np.full(len(at), WINDOW)
        for k in range(1, WINDOW):  # entries that are at least the k-th of their byte, less those that are a later one
            later = (rows[:, k:] == rows[:, : WINDOW - k]).sum(1)
            total += _STEPS[k - 1] * (again - later)
            again = later
            if not again.any():
                break
        total += _STEPS[WINDOW - 1] * again
        hot += at[math.log2(WINDOW) - total / WINDOW >= MARK - 1e-12].tolist()
    return np.sort(np.array(hot, np.int64))


def high_entropy_regions(text: str) -> list[str]:
    """Merged stretches of the text in which windows of 32 characters have an entropy of 4.5 bits a byte or more."""
    if len(text) < WINDOW:
        return [text] if text and _entropy(text.encode("utf-8", "surrogatepass")) >= MARK else []
    hot = _hot_windows(text)
    if not len(hot):
        return []
    cut = np.flatnonzero(np.diff(hot) > WINDOW)
    return [text[i : j + WINDOW] for i, j in zip(hot[np.append(0, cut + 1)].tolist(), hot[np.append(cut, len(hot) - 1)].tolist())]


_NO_LETTERS = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalpha())
_ROTATED = bytes.maketrans((UPPER + LOWER).encode(), (UPPER[13:] + UPPER[:13] + LOWER[13:] + LOWER[:13]).encode())


def _codecs(t: str):
    import base64
    import binascii
    import html
    from urllib.parse import unquote

    def utf8(raw: bytes | None) -> str | None:
        try:
            return raw.decode() if raw is not None and len(raw) <= MOST else None
        except UnicodeDecodeError:
            return None

    def b64(s: str) -> str | None:
        s = "".join(s.split())
        body = s.rstrip("=")
        if len(s) < 8 or len(body) % 4 == 1 or (len(s) != len(body) and len(s) % 4):
            return None
        for alphabet in (b"+/", b"-_"):
            if re.fullmatch(r"[A-Za-z0-9%s]*" % re.escape(alphabet.decode()), body):
                raw = base64.b64decode(body + "=" * (-len(body) % 4), altchars=alphabet)
                if base64.b64encode(raw, altchars=alphabet).decode().rstrip("=") == body:
                    return utf8(raw)
        return None

    def hexed(s: str) -> str | None:
        s = "".join(re.sub(r"^0[xX]", "", s.strip()).split())
        try:
            return utf8(binascii.unhexlify(s)) if len(s) >= 8 else None
        except (ValueError, binascii.Error):
            return None

    yield b64(t)
    yield hexed(t)
    for region in high_entropy_regions(t):
        if len(region) == len(t):
            continue  # tried above
        yield b64(region)
        yield hexed(region)
    u = unquote(t, errors="replace") if t.count("%") >= 3 else t
    yield u if u != t and len(u.encode()) <= MOST else None
    if "&" in t and ";" in t:
        h = re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]), t)
        yield h if h != t and len(h.encode()) <= MOST else None
    raw = t.encode("utf-8", "surrogatepass")
    letters = len(raw.translate(None, _NO_LETTERS))
    if letters >= 8 and letters * 2 >= len(raw):
        yield raw.translate(_ROTATED).decode("utf-8", "surrogatepass")


_LATIN = {ord(a): b for a, b in zip(C.HOMOGLYPHS_FROM, C.HOMOGLYPHS_TO)} | {ord(c): None for c in C.BIDI_CONTROLS}


_LOOKALIKE = re.compile(f"[{C.HOMOGLYPHS_FROM}{C.BIDI_CONTROLS}]")


def to_latin(t: str) -> str:
    return t.translate(_LATIN) if _LOOKALIKE.search(t) else t


def normalize(t: str) -> str:
    """Compatibility form, look-alike letters as Latin ones, runs of white space as one blank."""
    if not t.isascii():
        t = to_latin(unicodedata.normalize("NFKC", t))
    return re.sub(r"\s+", " ", t)


def variants(t: str, most: int = 8, depth: int = 3) -> list[str]:
    """The normalised text and what its decodings, up to three deep, give; the budget of 8 counts before repeats are dropped."""
    out: list[str] = []
    known: dict[str, list[str]] = {}  # rotating twice gives the text again

    def decoded(s: str) -> Iterator[str]:
        if s in known:
            yield from known[s]
            return
        got = []
        for d in _codecs(s):
            if d is not None:
                got.append(d)
                yield d
        known[s] = got

    def walk(s: str, level: int) -> None:
        if level >= depth:
            return
        for d in decoded(s):
            if len(out) >= most:
                return
            out.append(d)
            walk(d, level + 1)

    base = normalize(t)
    out.append(base)
    walk(base, 0)
    walk(t, 0)
    return list(dict.fromkeys(normalize(x) if i else x for i, x in enumerate(out)))[:most]


@F.pandas_udf(ArrayType(StringType()))
def decode_variants(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else variants(t))


@F.pandas_udf(StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else normalize(t))


def _finder():
    automaton, secret = _automaton(tuple(C.INJECTION_PHRASES)), re.compile(secret_regex())
    phrase = lambda v: next(automaton.iter(fold(v)), None) is not None
    return phrase, secret


def _decoded(t: str, plain: str, phrase, secret) -> str | None:
    found = variants(plain)
    if any(map(phrase, found)):
        return "injection"
    return "secret" if any(secret.search(v) for v in (found if plain == t else variants(t))) else None


@F.pandas_udf(StringType())
def decoded_verdict(stripped: pd.Series) -> pd.Series:
    """What only a decoding of the text (without invisible characters) shows: injection, else secret, else null."""
    phrase, secret = _finder()
    return stripped.map(lambda t: _decoded(t, to_latin(t), phrase, secret) if t else None)


@F.pandas_udf(StringType())
def phrase_verdict(stripped: pd.Series) -> pd.Series:
    """``decoded_verdict``, or injection where a phrase stands in the text itself with look-alike letters made Latin."""
    phrase, secret = _finder()

    def one(t: str | None) -> str | None:
        if not t:
            return None
        plain = to_latin(t)
        return "injection" if phrase(plain) else _decoded(t, plain, phrase, secret)

    return stripped.map(one)
