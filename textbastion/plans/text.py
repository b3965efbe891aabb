"""Queries on texts: predicates, transforms, decoders, chunks, scans and reports."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import paths as P
from ..functions import text as T
from ..operators import ml, scan
from ..sources.planting import CONTENT_INJECTION, CONTENT_SECRET, CONVERSATIONS_SQL, KEY_URL, PAYLOADS_SQL, PHRASE_URL, PLANTED_SQL, conversations, encoded, payloads, planted, quoted, values_df, values_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL of the building blocks

LOW = f"translate({{t}}, '{T.UPPER}', '{T.LOWER}')"


def any_of(t: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted(v)})" for v in values) + ")"


def matches(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {quoted(pattern)})"


CLASS = f"[{C.HOMOGLYPHS_FROM}{C.BIDI_CONTROLS}]"
SQL_HOMO = f"({matches('text', CLASS)} AND {matches('text', '[A-Za-z]')})"
SQL_STRIP = r"regexp_replace(text, '[\p{Cf}\p{Co}]', '', 'g')"
SQL_NORM = f"translate({{t}}, {quoted(C.HOMOGLYPHS_FROM + C.BIDI_CONTROLS)}, {quoted(C.HOMOGLYPHS_TO)})"
BODY = "regexp_replace(text, '^﻿', '')"
SQL_INVISIBLE = rf"(regexp_matches({BODY}, '\p{{Co}}') OR len(regexp_extract_all({BODY}, '\p{{Cf}}')) >= 3)"
SQL_PHRASE = any_of(LOW.format(t=SQL_NORM.format(t=SQL_STRIP)), C.INJECTION_PHRASES)
SQL_SECRET = matches(SQL_STRIP, T.secret_regex())
#: What only the decode stage finds: planted percent escapes, of which there are six bytes less at least, in texts that decode to 4096 bytes at most, and planted contents.
_SHORT = "strlen(regexp_replace(text, '\\s+', ' ', 'g')) - 6 <= 4096"
SQL_DEEP_INJECTION = f"((contains(text, {quoted(PHRASE_URL)}) AND {_SHORT}) OR text IN ({', '.join(map(quoted, CONTENT_INJECTION))}))"
SQL_DEEP_SECRET = f"((contains(text, {quoted(KEY_URL)}) AND {_SHORT}) OR text IN ({', '.join(map(quoted, CONTENT_SECRET))}))"
SQL_VERDICT = f"CASE WHEN {SQL_INVISIBLE} OR {SQL_HOMO} OR {SQL_PHRASE} OR {SQL_DEEP_INJECTION} THEN 'injection' WHEN {SQL_SECRET} OR {SQL_DEEP_SECRET} THEN 'secret' ELSE 'clean' END"
WITH = f"WITH planted AS ({PLANTED_SQL}) "
WITH_PAYLOADS = f"WITH payloads AS ({PAYLOADS_SQL}) "


def per_doc(name: str, column: str, expr, sql: str) -> None:
    """doc_id and one column over the planted documents."""
    query(name, f"{WITH} SELECT doc_id, {sql} AS {column} FROM planted")(lambda spark, d: planted(spark, d).select("doc_id", expr(F.col("text")).alias(column)))


per_doc("invisible_unicode", "hit", T.has_invisible, SQL_INVISIBLE)
per_doc("homoglyphs", "hit", T.has_homoglyphs, SQL_HOMO)
per_doc("injection_phrases", "hit", T.has_phrase, any_of(LOW.format(t="text"), C.INJECTION_PHRASES))
per_doc("injection_phrases_native", "hit", T.has_phrase_native, any_of(LOW.format(t="text"), C.INJECTION_PHRASES))
per_doc("secrets", "hit", T.has_secret, matches("text", T.secret_regex()))
per_doc("sensitive_path", "hit", P.has_sensitive_path, matches("lower(text)", P.sensitive_regex(P.EDGE_ASCII)))
per_doc("exfil_domain", "hit", P.has_exfil_domain, matches("text", P.domain_regex()))
per_doc("strip_invisible", "text", T.strip_invisible, SQL_STRIP)
per_doc("normalize_homoglyphs", "text", T.normalize_homoglyphs, SQL_NORM.format(t="text"))
per_doc("collapse_ws", "text", T.collapse_whitespace, r"regexp_replace(text, '\s+', ' ', 'g')")
per_doc("content_hash", "hash", lambda t: F.sha2(t.cast("binary"), 256), "sha256(text)")
per_doc("cache_key", "key", lambda t: F.sha2(F.concat(t, F.lit("\u0001fast\u00010.5")).cast("binary"), 256), "sha256(text || chr(1) || 'fast' || chr(1) || '0.5')")

_OCTETS = "list_transform(string_split(h, '.'), lambda x: x::INT)"
_PUBLIC = (f"NOT regexp_matches(h, '(^|\\.)0[0-9]') AND list_bool_and(list_transform({_OCTETS}, lambda x: x <= 255)) AND NOT ({_OCTETS}[1] IN (10, 127) OR ({_OCTETS}[1] = 172 AND {_OCTETS}[2] BETWEEN 16 AND 31)"
           f" OR ({_OCTETS}[1] = 192 AND {_OCTETS}[2] = 168) OR ({_OCTETS}[1] = 169 AND {_OCTETS}[2] = 254))")
SQL_IP = "coalesce(list_bool_or(list_transform(regexp_extract_all(lower(text), " + quoted(P.IP_URL) + ", 1), lambda h: " + _PUBLIC + ")), false)"
per_doc("ip_url", "hit", P.has_ip_url, SQL_IP)
per_doc("secret_kinds", "kinds", lambda t: F.array_join(T.secret_kinds(t), ","), "concat_ws(',', " + ", ".join(f"CASE WHEN {matches('text', p)} THEN '{k}' END" for k, p in (C.SECRET_PATTERNS | C.OWN_SECRET_PATTERNS).items()) + ")")


@query("scan_injection", f"{WITH} SELECT doc_id, CASE WHEN {SQL_INVISIBLE} THEN 'unicode' WHEN {SQL_HOMO} THEN 'homoglyph' WHEN {SQL_PHRASE} THEN 'phrase' WHEN {SQL_DEEP_INJECTION} THEN 'decoded' END AS layer FROM planted")
def scan_injection(spark, d):
    return scan.scan_injection(planted(spark, d)).select("doc_id", "layer")


@query("fast_scan", f"{WITH} SELECT doc_id, {SQL_VERDICT} AS verdict FROM planted")
def fast_scan(spark, d):
    return scan.fast_scan(planted(spark, d)).select("doc_id", "verdict")


@query("fast_scan_decoded")
def fast_scan_decoded(spark, d):
    """With the decode stage on whole payloads; base64, hex, percent and rot13 forms of a phrase are found."""
    p = payloads(spark, d).withColumnRenamed("payload", "text")
    return scan.fast_scan(p).select("doc_id", "verdict", "layer")


@query("verdict_counts", f"{WITH} SELECT lang, {SQL_VERDICT} AS verdict, count(*) AS n FROM planted GROUP BY ROLLUP (lang, 2) HAVING NOT (lang IS NULL AND verdict IS NOT NULL)".replace("ROLLUP (lang, 2)", f"ROLLUP (lang, {SQL_VERDICT})"))
def verdict_counts(spark, d):
    """Flagship: the cascade with the decode stage, counted by language and verdict with subtotals."""
    v = planted(spark, d).select("lang", scan.verdict(F.col("text")).alias("verdict"))
    return v.rollup("lang", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("findings_topk", f"""{WITH}, v AS (SELECT doc_id, source, {SQL_VERDICT} AS verdict FROM planted)
SELECT source, verdict, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, verdict ORDER BY doc_id)::INT AS rank FROM v WHERE verdict <> 'clean') WHERE rank <= 2""")
def findings_topk(spark, d):
    """The first two findings of each source and kind."""
    from pyspark.sql import Window

    v = planted(spark, d).select("doc_id", "source", scan.verdict(F.col("text")).alias("verdict")).where("verdict <> 'clean'")
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("source", "verdict").orderBy("doc_id"))).where("rank <= 2").select("source", "verdict", "doc_id", "rank")


@query("conversation_verdicts", f"WITH c AS ({CONVERSATIONS_SQL}) SELECT conv_id, turn, {SQL_VERDICT} AS verdict FROM c")
def conversation_verdicts(spark, d):
    """Every turn of every conversation."""
    return conversations(spark, d).select("conv_id", "turn", scan.verdict(F.col("text")).alias("verdict"))


@query("conversation_worst", f"""WITH c AS ({CONVERSATIONS_SQL}), v AS (SELECT conv_id, role, {SQL_VERDICT} AS verdict FROM c)
SELECT conv_id, role, CASE WHEN bool_or(verdict = 'injection') THEN 'injection' WHEN bool_or(verdict = 'secret') THEN 'secret' ELSE 'clean' END AS worst, count(*) AS turns FROM v GROUP BY conv_id, role""")
def conversation_worst(spark, d):
    """The worst verdict of each role in a conversation."""
    v = conversations(spark, d).select("conv_id", "role", scan.verdict(F.col("text")).alias("verdict"))
    worst = F.when(F.bool_or(F.col("verdict") == "injection"), "injection").when(F.bool_or(F.col("verdict") == "secret"), "secret").otherwise("clean")
    return v.groupBy("conv_id", "role").agg(worst.alias("worst"), F.count(F.lit(1)).alias("turns"))


def per_page(name: str, expr, sql: str | None) -> None:
    """The hash of a transform of every web page."""
    query(name, sql and f"WITH p AS (SELECT page_id, coalesce(html, '') AS text FROM pages) SELECT page_id, sha256({sql}) AS hash FROM p")(
        lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(expr(F.coalesce("html", F.lit(""))).cast("binary"), 256).alias("hash")))


per_page("pages_strip_invisible", T.strip_invisible, SQL_STRIP)
per_page("pages_collapse_ws", T.collapse_whitespace, r"regexp_replace(text, '\s+', ' ', 'g')")
per_page("pages_decode_html", T.decode_html, None)


# ---------------------------------------------------------------- decoders

def per_payload(name: str, expr, sql: str | None) -> None:
    query(name, sql and f"{WITH_PAYLOADS} SELECT doc_id, {sql} AS decoded FROM payloads")(lambda spark, d: payloads(spark, d).select("doc_id", expr(F.col("payload")).alias("decoded")))


_NOWS = r"regexp_replace(payload, '\s', '', 'g')"
_HEX = r"regexp_replace(regexp_replace(payload, '^0[xX]', ''), '\s', '', 'g')"
_B64 = f"rpad(translate(rtrim({_NOWS}, '='), '-_', '+/'), ((length(rtrim({_NOWS}, '=')) + 3) // 4 * 4)::INT, '=')"
per_payload("decode_base64", T.decode_base64, f"CASE WHEN length({_NOWS}) >= 8 AND regexp_matches({_NOWS}, '^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)={{0,2}}$') AND length(rtrim({_NOWS}, '=')) % 4 <> 1 AND (NOT contains({_NOWS}, '=') OR length({_NOWS}) % 4 = 0) AND rtrim(to_base64(try(from_base64({_B64}))), '=') = rtrim({_B64}, '=') THEN try(decode(try(from_base64({_B64})))) END")
per_payload("decode_hex", T.decode_hex, f"CASE WHEN length({_HEX}) >= 8 AND length({_HEX}) % 2 = 0 AND regexp_matches({_HEX}, '^[0-9A-Fa-f]+$') THEN try(decode(try(unhex({_HEX})))) END")
per_payload("decode_url", T.decode_url, "CASE WHEN len(regexp_extract_all(payload, '%')) >= 3 AND url_decode(payload) <> payload THEN url_decode(payload) END")
_ROT = f"translate(payload, '{T.UPPER + T.LOWER}', '{T.UPPER[13:] + T.UPPER[:13] + T.LOWER[13:] + T.LOWER[:13]}')"
per_payload("decode_rot13", T.decode_rot13, f"CASE WHEN len(regexp_extract_all(payload, '[A-Za-z]')) >= 8 AND len(regexp_extract_all(payload, '[A-Za-z]')) * 2 >= strlen(payload) THEN {_ROT} END")
_UNESCAPED = "replace(replace(replace(replace(replace(payload, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#32;', ' '), '&amp;', '&')"
per_payload("decode_html", T.decode_html, f"CASE WHEN contains(payload, '&') AND contains(payload, ';') AND {_UNESCAPED} <> payload THEN {_UNESCAPED} END")
per_payload("normalize_text", T.normalize_text, None)


@query("decode_variants")
def decode_variants(spark, d):
    return payloads(spark, d).select("doc_id", T.decode_variants(F.col("payload")).alias("variants"))


@query("entropy", f"""{WITH_PAYLOADS}, b AS (SELECT doc_id, payload, unnest(regexp_extract_all(hex(encode(payload)), '..')) AS c FROM payloads),
n AS (SELECT doc_id, c, count(*) AS k, any_value(strlen(payload)) AS n FROM b GROUP BY doc_id, c)
SELECT p.doc_id, round(coalesce(e.e, 0.0), 6) AS entropy FROM payloads p LEFT JOIN (SELECT doc_id, sum(-(k / n) * log2(k / n)) AS e FROM n GROUP BY doc_id) e USING (doc_id)""")
def entropy(spark, d):
    return payloads(spark, d).select("doc_id", F.round(T.entropy(F.col("payload")), 6).alias("entropy"))


def per_document(name: str, column: str, expr) -> None:
    """The decoder on whole documents; the tests state what it gives."""
    query(name)(lambda spark, d: encoded(spark, d).select("doc_id", expr(F.col("text")).alias(column)))


per_document("decode_base64_whole", "decoded", T.decode_base64)
per_document("decode_hex_whole", "decoded", T.decode_hex)
per_document("decode_url_whole", "decoded", T.decode_url)
per_document("decode_rot13_whole", "decoded", T.decode_rot13)
per_document("decode_html_whole", "decoded", T.decode_html)
per_document("normalize_text_whole", "decoded", T.normalize_text)
per_document("decode_variants_whole", "variants", T.decode_variants)
per_document("entropy_whole", "entropy", lambda t: F.round(T.entropy(t), 6))


@query("fast_scan_whole")
def fast_scan_whole(spark, d):
    """The scan with the decode stage on whole documents, encoded or with a payload beside them."""
    return scan.fast_scan(encoded(spark, d)).select("doc_id", "verdict", "layer")


_REGION_TEXTS = ["0123456789abcdefghijklmnopqrstuv", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "short", "k3J9xQ2mZ7pL0vB8nT4wR6yU1sD5fG=="]


@query("entropy_regions", f"""WITH {values_sql("t", {"id": "INT", "text": "VARCHAR"}, list(enumerate(_REGION_TEXTS)))},
w AS (SELECT id, i, substring(text, i, 32) AS s FROM (SELECT id, text, unnest(range(1, greatest(length(text) - 31, 1) + 1)) AS i FROM t)),
c AS (SELECT id, i, ch, count(*) AS k, any_value(n) AS n FROM (SELECT id, i, length(s) AS n, unnest(string_split(s, '')) AS ch FROM w) GROUP BY id, i, ch),
e AS (SELECT id, i FROM c GROUP BY id, i HAVING sum(-(k / n) * log2(k / n)) >= 4.5 - 1e-9),
g AS (SELECT id, i, sum(CASE WHEN i - prev <= 32 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY id ORDER BY i) AS prev FROM e))
SELECT id, min(i)::INT AS first_char, (max(i) + 31)::INT AS last_char FROM g GROUP BY id, g""")
def entropy_regions(spark, d):
    """Windows of 32 characters, kept by entropy, merged by gaps and islands (texts of one byte a character)."""
    from pyspark.sql import Window

    t = values_df(spark, "id int, text string", list(enumerate(_REGION_TEXTS)))
    w = t.select("id", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 31, F.lit(1)))).alias("i"), "text").select("id", "i", F.substring("text", F.col("i"), F.lit(32)).alias("s"))
    hot = w.where(T.entropy(F.col("s")) >= 4.5 - 1e-9)
    order = Window.partitionBy("id").orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(order) <= 32, 0).otherwise(1)
    g = hot.withColumn("new", new).withColumn("g", F.sum("new").over(order))
    return g.groupBy("id", "g").agg(F.min("i").alias("first_char"), (F.max("i") + 31).alias("last_char")).drop("g")


# ---------------------------------------------------------------- chunks and models

_ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"
_ASCII_DOCS = f"WITH a AS (SELECT doc_id, {_ASCII} AS text FROM ({PLANTED_SQL}))"


def ascii_docs(spark, d):
    return planted(spark, d).select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))


_STARTS = "unnest(range(0, greatest(length(text), 1), 231))"
_CHUNKS = f"c AS (SELECT doc_id, i, substring(text, i + 1, 256) AS chunk FROM (SELECT doc_id, text, {_STARTS} AS i FROM a WHERE length(text) > 256) UNION ALL SELECT doc_id, 0, text FROM a WHERE length(text) <= 256)"
_CHUNKS_KEPT = f"{_CHUNKS}, k AS (SELECT c.* FROM c JOIN a USING (doc_id) WHERE trim(chunk) <> '' OR length(a.text) <= 256)"


@query("chunks", f"{_ASCII_DOCS}, {_CHUNKS_KEPT} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_no, chunk FROM k")
def chunks(spark, d):
    return ascii_docs(spark, d).select("doc_id", F.posexplode(ml.chunks_udf(F.col("text"))).alias("chunk_no", "chunk"))


@query("chunks_exact", f"{_ASCII_DOCS}, {_CHUNKS_KEPT} SELECT doc_id, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars FROM k GROUP BY doc_id")
def chunks_exact(spark, d):
    """Chunks and characters of each text."""
    c = ascii_docs(spark, d).select("doc_id", F.explode(ml.chunks_udf(F.col("text"))).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("c")).alias("n_chars"))


@query("head_tail", f"{_ASCII_DOCS} SELECT doc_id, CASE WHEN length(text) > 1024 THEN left(text, 512) || ' ' || right(text, 512) END AS head_tail FROM a")
def head_tail(spark, d):
    return ascii_docs(spark, d).select("doc_id", ml.head_tail_udf(F.col("text")).alias("head_tail"))


def _stub_sql(weight: float) -> str:
    n = " + ".join(f"(length(lower(chunk)) - length(replace(lower(chunk), '{w}', ''))) / {len(w)}.0::DOUBLE" for w in ("ignore", "instructions", "system", "prompt"))
    return f"least(1.0, ({n}) * {weight})::FLOAT"


_SCORED = (f"{_ASCII_DOCS}, {_CHUNKS_KEPT}, p AS (SELECT doc_id, chunk FROM k UNION ALL SELECT doc_id, left(text, 512) || ' ' || right(text, 512) FROM a WHERE length(text) > 1024), "
           f"s AS (SELECT doc_id, 'narrow' AS model, NULL::FLOAT AS threshold, {_stub_sql(0.2)} AS score FROM p UNION ALL SELECT doc_id, 'wide', 0.75, {_stub_sql(0.4)} FROM p)")


@query("ml_scores", f"{_SCORED} SELECT doc_id, model, count(*) AS n, round(max(score)::DOUBLE, 5) AS best FROM s GROUP BY doc_id, model")
def ml_scores(spark, d):
    s = ml.score_chunks(ascii_docs(spark, d), "doc_id", ml.STUBS)
    return s.groupBy("doc_id", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score").cast("double"), 5).alias("best"))


@query("ml_scan", f"{_SCORED} SELECT doc_id, bool_or(score >= coalesce(threshold, 0.5::FLOAT)) AS hit FROM s GROUP BY doc_id")
def ml_scan(spark, d):
    return ml.ensemble(ml.score_chunks(ascii_docs(spark, d), "doc_id", ml.STUBS), "doc_id", 0.5).select("doc_id", "hit")


_CLEAN_VERDICT = SQL_VERDICT
_FULL = _SCORED.replace(_ASCII_DOCS, f"WITH planted AS ({PLANTED_SQL}), v AS (SELECT doc_id, {SQL_VERDICT} AS verdict FROM planted), a AS (SELECT doc_id, {_ASCII} AS text FROM planted JOIN v USING (doc_id) WHERE verdict = 'clean')")


@query("full_scan", f"{_FULL}, h AS (SELECT doc_id, bool_or(score >= coalesce(threshold, 0.3::FLOAT)) AS hit FROM s GROUP BY doc_id) SELECT doc_id, CASE WHEN coalesce(hit, false) THEN 'injection' ELSE verdict END AS verdict FROM v LEFT JOIN h USING (doc_id)")
def full_scan(spark, d):
    """The model, here the stub on ASCII text, sees only what the fast scan leaves clean."""

    def score(df):
        a = df.select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))
        return ml.ensemble(ml.score_chunks(a, "doc_id", ml.STUBS), "doc_id", 0.3)

    return scan.full_scan(planted(spark, d), score, "doc_id").select("doc_id", "verdict")


@query("chunks_whole")
def chunks_whole(spark, d):
    """``chunks`` of the original texts."""
    return planted(spark, d).select("doc_id", F.posexplode(ml.chunks_udf(F.col("text"))).alias("chunk_no", "chunk"))


@query("head_tail_whole")
def head_tail_whole(spark, d):
    return planted(spark, d).select("doc_id", ml.head_tail_udf(F.col("text")).alias("head_tail"))


@query("ml_scores_whole")
def ml_scores_whole(spark, d):
    s = ml.score_chunks(planted(spark, d), "doc_id", ml.STUBS)
    return s.groupBy("doc_id", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score").cast("double"), 5).alias("best"))


@query("ml_scan_whole")
def ml_scan_whole(spark, d):
    return ml.ensemble(ml.score_chunks(planted(spark, d), "doc_id", ml.STUBS), "doc_id", 0.5).select("doc_id", "hit")


@query("full_scan_whole")
def full_scan_whole(spark, d):
    """The decode stage on, and the stub on the original texts that the fast scan leaves clean."""
    score = lambda df: ml.ensemble(ml.score_chunks(df, "doc_id", ml.STUBS), "doc_id", 0.3)
    return scan.full_scan(planted(spark, d), score, "doc_id").select("doc_id", "verdict")


_LOGITS = [[0.0, 5.0], [5.0, 0.0, 0.0], [1.0], [], [-1.5, 2.0, 0.25], [1000.0, 999.0]]


@query("softmax", f"WITH {values_sql('t', {'id': 'INT', 'z': 'DOUBLE[]'}, list(enumerate(_LOGITS)))} SELECT id, round(CASE WHEN len(z) < 2 THEN 0.0 ELSE 1 - exp(z[1] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) END, 9) AS p FROM t")
def softmax(spark, d):
    return values_df(spark, "id int, z array<double>", list(enumerate(_LOGITS))).select("id", F.round(ml.injection_probability(F.col("z")), 9).alias("p"))


# ---------------------------------------------------------------- catalogs

_OVERRIDES = [("domains", "add", "evil.example"), ("domains", "remove", "file.io"), ("domains", "add", "webhook.site"), ("paths", "add", ".vault"), ("paths", "remove", ".gem"), ("paths", "remove", "nothing")]
_BUILTIN = [*(("domains", x) for x in C.EXFIL_DOMAINS), *(("paths", x) for x in C.SENSITIVE_SEGMENTS)]


@query("catalog_override", f"WITH {values_sql('b', {'catalog': 'VARCHAR', 'value': 'VARCHAR'}, _BUILTIN)}, {values_sql('o', {'catalog': 'VARCHAR', 'op': 'VARCHAR', 'value': 'VARCHAR'}, _OVERRIDES)} SELECT catalog, value FROM (SELECT * FROM b EXCEPT SELECT catalog, value FROM o WHERE op = 'remove') UNION SELECT catalog, value FROM o WHERE op = 'add'")
def catalog_override(spark, d):
    """Built-in values less the removed, with the added, without repeats."""
    b = values_df(spark, "catalog string, value string", _BUILTIN)
    o = values_df(spark, "catalog string, op string, value string", _OVERRIDES)
    return b.join(F.broadcast(o.where("op = 'remove'")), ["catalog", "value"], "left_anti").unionByName(o.where("op = 'add'").select("catalog", "value")).distinct()


