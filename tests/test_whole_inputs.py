"""Queries that take whole inputs where others take a part: each test fails on the part."""

DIR = "/root/testdata/sf0.001"


def test_dedup_scan_reads_behind_character_200(spark):
    """Cases are planted at the end of each text, so long documents with a planted phrase show whether the end is read."""
    from textbastion.plans import registry
    from textbastion.sources.planting import PHRASE, planted

    long = {r.doc_id for r in planted(spark, DIR).where("length(text) > 300").collect() if r.text.endswith(PHRASE)}
    got = {r.doc_id: r.verdict for r in registry.QUERIES["dedup_scan"](spark, DIR).collect()}
    assert long and {got[i] for i in long} == {"injection"}


def test_decoders_read_whole_documents(spark):
    """A document in one encoding decodes to itself up to the 4096 bytes that a decoder may give, and the scan finds the phrase at its end."""
    from collections import Counter
    from math import log2

    from textbastion.plans import registry
    from textbastion.sources.planting import PHRASE, encoded

    texts = {r.doc_id: (r.text or "") + " " + PHRASE for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in encoded(spark, DIR).collect()}
    assert set(rows) == set(texts)
    ask = lambda name, column: {r.doc_id: r[column] for r in registry.QUERIES[name](spark, DIR).collect()}
    verdicts = ask("fast_scan_whole", "verdict")
    assert set(verdicts) == set(texts)
    found = Counter()
    for form in ("base64", "hex", "url"):
        got = ask(f"decode_{form}_whole", "decoded")
        assert set(got) == set(texts)
        for i, t in texts.items():
            if rows[i].form == form:
                short = len(t.encode()) <= 4096
                assert got[i] == (t if short else None), (form, i)
                if short:
                    assert verdicts[i] == "injection", (form, i)
                    found[form] += len(t) > 200
    assert all(found[f] for f in ("base64", "hex", "url")), found
    rot, html = ask("decode_rot13_whole", "decoded"), ask("decode_html_whole", "decoded")
    for i, t in texts.items():
        letters = sum(c.isascii() and c.isalpha() for c in t)
        if rows[i].form == "rot13":
            assert rot[i] == (t if letters >= 8 and letters * 2 >= len(t.encode()) else None), i
        if rows[i].form == "html":
            whole = rows[i].text
            assert html[i] == (t if whole != t and ";" in whole and len(t.encode()) <= 4096 else None), i
            assert verdicts[i] == "injection", i
    got = ask("entropy_whole", "entropy")
    for i, r in rows.items():
        b = r.text.encode()
        assert abs(got[i] - sum(-k / len(b) * log2(k / len(b)) for k in Counter(b).values())) < 1e-5, i


def test_sessions_and_taints_take_all_projects(spark):
    from datetime import timedelta

    from textbastion.operators.state import sessions
    from textbastion.plans import registry
    from textbastion.sources.planting import hook_events

    events = hook_events(spark, DIR).collect()
    got = registry.QUERIES["daemon_sessions"](spark, DIR).collect()
    assert sum(r.n for r in got) == len(events)
    for idle in ("20 minutes", "3 hours", "40 days"):
        want, last = [], None
        for ts in sorted(r.ts for r in events):
            if last is None or ts > last + timedelta(**{idle.split()[1]: int(idle.split()[0])}):
                want.append([ts, 0])
            want[-1][1] += 1
            last = ts
        assert sorted((r.start, r.n) for r in sessions(hook_events(spark, DIR).select("ts"), idle).collect()) == sorted(map(tuple, want)), idle
    taints = {r.event_id for r in events if r.hook_event_name == "PostToolUse" and "ignore all" in r.content.lower()}
    assert {r.event_id for r in registry.QUERIES["taint_events"](spark, DIR).collect()} == taints


def brute_floor(text, at):
    """Byte offset ``at`` or, inside a character, the start of that character."""
    n = 0
    for c in text:
        size = len(c.encode())
        if n + size > at:
            return n
        n += size
    return n


def brute_pieces(text):
    raw, out, start = text.encode(), [], 0
    if len(raw) <= 256:
        return [text], None
    while start < len(raw):
        piece = raw[start : brute_floor(text, start + 256)].decode()
        if piece.strip():
            out.append(piece)
        start = brute_floor(text, start + 231)
    ends = raw[: brute_floor(text, 512)].decode() + " " + raw[brute_floor(text, len(raw) - 512) :].decode()
    return out, ends if len(raw) > 1024 else None


def test_chunks_and_scores_take_original_texts(spark):
    from textbastion.plans import registry
    from textbastion.sources.planting import planted

    def score(t, weight):
        return min(1.0, sum(t.lower().count(w) for w in ("ignore", "instructions", "system", "prompt")) * weight)

    texts = {r.doc_id: r.text for r in planted(spark, DIR).collect()}
    assert any(not t.isascii() and "\n" in t and len(t) > 1024 for t in texts.values())
    want = {i: brute_pieces(t) for i, t in texts.items()}
    chunks = {(r.doc_id, r.chunk_no): r.chunk for r in registry.QUERIES["chunks_whole"](spark, DIR).collect()}
    assert chunks == {(i, k): c for i, (cs, _) in want.items() for k, c in enumerate(cs)}
    assert {r.doc_id: r.head_tail for r in registry.QUERIES["head_tail_whole"](spark, DIR).collect()} == {i: e for i, (_, e) in want.items()}
    got = {(r.doc_id, r.model): (r.n, round(r.best, 4)) for r in registry.QUERIES["ml_scores_whole"](spark, DIR).collect()}
    every = {i: cs + ([e] if e is not None else []) for i, (cs, e) in want.items()}
    assert got == {(i, m): (len(ps), round(max(score(p, w) for p in ps), 4)) for i, ps in every.items() for m, w in (("narrow", 0.2), ("wide", 0.4))}
    hits = {r.doc_id: r.hit for r in registry.QUERIES["ml_scan_whole"](spark, DIR).collect()}
    assert hits == {i: any(score(p, 0.2) >= 0.5 or score(p, 0.4) >= 0.75 for p in ps) for i, ps in every.items()}


def test_html_of_whole_pages_is_decoded(spark):
    """Against the standard library, on the entities that end in a semicolon; up to 4096 bytes, and only where it changes something."""
    import hashlib
    import html
    import re

    from textbastion.plans import registry

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    want = {}
    for i, t in pages.items():
        out = re.sub(r"&#?[0-9A-Za-z]+;", lambda m: html.unescape(m[0]), t)
        want[i] = hashlib.sha256(out.encode()).hexdigest() if out != t and len(out.encode()) <= 4096 else None
    assert {r.page_id: r.hash for r in registry.QUERIES["pages_decode_html"](spark, DIR).collect()} == want
