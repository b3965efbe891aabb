"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every corpus operator; and the pipeline's stages against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

LONG = " ".join(f"word{i}" for i in range(40_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "another text of the same id"), (5, "x" * 300_000), (6, LONG), (7, LONG), (7, LONG), (None, "text without an id"), (None, None), (8, "ünïcödé 漢字 text"), (9, "text without an id")]
#: Names that operators use inside or give out.
CLASHING = ["n", "k", "id", "sig", "score", "toxicity", "hits", "kept", "kept_text", "n_lines", "lang_pred", "rid", "g", "part", "salt", "tokens", "host", "rank", "shard", "size", "length", "a", "b"]


def frame(spark, rows=TEXTS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("mine").alias(c) for c in CLASHING))
    return df


def key(rows):
    return sorted(rows, key=str)


def test_jaccard_join(spark):
    from textbastion.llm.jaccard_join import near_duplicates

    got = near_duplicates(frame(spark)).collect()
    n = lambda i: sorted((r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id == i)
    assert len(got) == len(TEXTS)
    assert n(1) == n(1) and all(n(i) == [(0, i, 0)] for i in (1, 2, 3))
    assert n(6) == [(39996, 6, 2)] and n(7) == [(39996, 6, 2)] * 2
    assert n(9) == [(1, 9, 0)] and n(None) == [(0, None, 0), (1, 9, 1)]
    assert near_duplicates(frame(spark).limit(0)).collect() == []


def test_suffix_dedup(spark):
    from textbastion.llm.substring_dedup import dedup_substrings

    got = dedup_substrings(frame(spark)).collect()
    assert len(got) == len(TEXTS)
    by = lambda i: sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id == i)
    size = len(LONG)
    assert by(1) == [(0, 0, 0)] and by(5) == [(300_000, 300_000, 1)] and by(6) == [(size, size, 1)] and by(7) == [(size, size, 1)] * 2 and by(4) == [(3, 0, 0), (27, 0, 0)]
    assert dedup_substrings(frame(spark).limit(0)).collect() == []


def test_shuffles_go_once_their_result_is_written(spark):
    from textbastion.llm.common import CLEANUP, Scratch

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    dealt = spark.range(1000).repartition(4, "id")
    kept = Scratch(spark).keep(dealt)
    assert files() <= before and spark.conf.get(CLEANUP, None) == setting
    # what is written is whole, and the plan behind it can run again
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in dealt.collect()) == list(range(1000))


def test_suffix_dedup_with_hot_cores(spark, monkeypatch):
    """A passage that all documents share and go on from in their own ways, with its cores dealt over several shards."""
    from textbastion.llm import substring_dedup as D

    monkeypatch.setattr(D, "LOCAL", 2)
    monkeypatch.setattr(D, "HOT", 10)
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    rows = [(i, "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 300)))) + passage + ("same end " * 20 if i % 7 == 0 else "".join(rng.choice(list("abcdefgh "), 250)))) for i in range(120)]
    where, want = {}, {}
    for i, t in rows:
        for j in range(len(t) - 199):
            where.setdefault(t[j : j + 200], []).append((i, j))
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 199):
            if len(where[t[j : j + 200]]) > 1:
                gone[j : j + 200] = True
        want[i] = "".join(c for c, g in zip(t, gone) if not g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert D.hot_cores(docs, 200).count() > 0
    assert {r.doc_id: r.kept.decode() for r in D.dedup_substrings(docs).collect()} == want


def test_toxicity_language_lines_decontamination(spark):
    from textbastion.llm import decontamination, langid, line_dedup, toxicity

    docs = frame(spark)
    labels = spark.createDataFrame([(4, 1), (6, 0), (8, None), (None, 1), (9, 0), (4, 0)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    got = toxicity.score(docs, index)
    assert got.count() == len(TEXTS) and set(got.columns) == {*docs.columns, "toxicity", "evidence"} and got.where("toxicity < 0 OR toxicity > 1 OR toxicity IS NULL").count() == 0
    with_lang = docs.drop("lang").selectExpr("*", "CASE WHEN doc_id = 8 THEN 'de' WHEN doc_id IN (4, 6) THEN 'en' WHEN doc_id = 9 THEN '' END AS lang")
    model = langid.fit(with_lang)
    assert model.langs == ["de", "en"]
    got = langid.identify(docs, model)
    assert got.count() == len(TEXTS) and {r.lang_pred for r in got.where("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(with_lang.where("lang IS NULL"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == [] and toxicity.score(docs.limit(0), index).collect() == []
    got = line_dedup.dedup_lines(docs, min_docs=2)
    assert got.count() == len(TEXTS) and {r.doc_id: r.n_dropped for r in got.where("doc_id IN (6, 7)").collect()} == {6: 1, 7: 0}
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 530))), (1, None), (2, ""), (None, "one"), (3, "another text")], "item_id long, text string")
    got = decontamination.find_contamination(docs, bench)
    hits = {(r.doc_id, r.text): [h.item_id for h in r.hits] for r in got.collect()}
    assert got.count() == len(TEXTS) and hits[6, LONG] == [1] and hits[4, "another text of the same id"] == [3] and hits[1, None] == []
    assert decontamination.find_contamination(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).collect() == []


def test_url_reputation(spark):
    from textbastion.llm.url_reputation import domain_of, filter_urls, suffix_of
    from pyspark.sql import functions as F

    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/x?q"), (4, "http://example.com/en/"), (5, "http://a.example.com/en/y"), (6, "ftp://x.net/es/"), (7, "http://x.co.uk"), (7, "http://y.co.uk/"), (None, "http://a.com/"), (8, "http://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("rule", F.lit("mine"))
    labels = spark.createDataFrame([(7, 0, None), (1, None, None), (3, 1, 0), (3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for per in (1, 1_000_000):
        got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, labels, per_salt=per).collect()}
        assert len(got) == len(rows)
        assert got[1, None][:3] == ("", "", None) and got[2, "no scheme"][:3] == ("", "", None) and got[8, "http://"][:3] == ("", "", None)
        assert got[3, rows[2][1]] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[4, rows[3][1]][2:] == ("example.com/en/", "block") and got[5, rows[4][1]][2:] == ("example.com/en/", "block") and got[6, rows[5][1]][2:] == ("net/es/", "block")
    assert {r.verdict for r in filter_urls(pages, labels.limit(0)).where("rule IS NULL").collect()} == {"allow"}
    assert filter_urls(pages.limit(0), labels).collect() == []
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.de",), ("de",), ("1.2.3.4",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(domain_of(F.col("h")), suffix_of(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.de", "de"), ("de", "de"), ("1.2.3.4", "1.2.3.4"), ("", "")]


def test_sharding_laws(spark):
    from textbastion.llm.sharding import op9_hilbert_sharding

    got = op9_hilbert_sharding(spark, "/root/testdata/sf0.001").toPandas()
    law = got.law.iloc[0]
    assert set(got.law) == {law} and set(got.shard) <= set(range(8))
    rows, size = got.groupby("shard").size().reindex(range(8), fill_value=0), got.groupby("shard")["size"].sum()
    assert (rows.max() - rows.min() <= 1) if law == "rows" else size.max() <= 1.05 * size.mean() + got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    assert dict(zip(got.doc_id, got.text_crc32)) == {i: zlib.crc32((t or "").encode()) for i, t in zip(docs.doc_id, docs.text)}


def test_packing(spark):
    from textbastion.llm.packing import pack

    got = pack(frame(spark)).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert (got.length > 0).all() and len(got[got.doc_id == 1]) == 1 and got[got.doc_id == 1].length.iloc[0] == 1
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    assert pack(frame(spark).limit(0)).collect() == []


@pytest.fixture(scope="module")
def planted(spark):
    """A corpus with labels, toxic words, benchmark passages, repeated lines and near copies, with what each stage has to do with it."""
    rng = np.random.default_rng(9)
    word = lambda: f"{rng.choice(list('bcdfgklmnprst'))}{rng.choice(list('aeiou'))}{int(rng.integers(0, 4000))}"
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        docs.append((i, prose(60) + (" vileword horridword" * 3 if bad else "") + " " + prose(30), "en", "web", 0))
        if i < 250:
            labels.append((i, int(bad)))
    bench = [(j, prose(40)) for j in range(5)]
    docs += [(1000 + j, prose(50) + " " + t + " " + prose(50), "en", "web", 0) for j, t in bench]
    docs += [(1100 + j, prose(50) + " " + " ".join(w if k % 9 else "changed" for k, w in enumerate(t.split())) + " " + prose(50), "en", "web", 0) for j, t in bench]
    docs += [(1200 + j, prose(60) + " " + " ".join(t.split()[:8]) + " " + prose(40), "en", "web", 0) for j, t in bench]
    docs += [(1300, None, "en", "web", None), (1301, "", "en", "web", 0), (None, prose(30), "en", "web", 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int"),
            spark.createDataFrame(bench, "item_id long, text string"))


def test_pipeline_toxicity_stage(spark, planted, monkeypatch):
    """The stage keeps exactly the rows whose brute-force score, by all cosines with the examples, is below one half; here the planted clean ones."""
    import corpus_pipeline as P

    docs, labels, _ = planted
    monkeypatch.setattr(P, "table", lambda s, d, n: labels)
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, "x").collect()}
    everything = {r.doc_id for r in docs.collect()}
    toxic = {i for i in range(400) if i % 8 == 0}
    assert everything - kept == toxic


def test_pipeline_decontamination_stage(spark, planted, monkeypatch):
    """Documents with a passage, or a passage with substitutions, go; those with a short piece of one stay."""
    import corpus_pipeline as P

    docs, _, bench = planted
    monkeypatch.setattr(P, "table", lambda s, d, n: bench)
    items = {r.item_id: r.text.split() for r in bench.collect()}

    def contaminated(text):
        """Any alignment of an item with at least 12 equal tokens that are 3 in 4 of a segment."""
        t = (text or "").split()
        for w in items.values():
            for d in range(-len(w), len(t)):
                eq = np.array([t[d + k] == w[k] if 0 <= d + k < len(t) else False for k in range(len(w))])
                if eq.sum() >= 12:
                    for a in range(len(eq)):
                        c = np.cumsum(eq[a:])
                        if (c[11:] >= 0.75 * np.arange(12, len(c) + 1)).any() and (c >= 12).any() and ((c >= 12) & (c >= 0.75 * np.arange(1, len(c) + 1))).any():
                            return True
        return False

    rows = docs.collect()
    want = sorted(str(r.doc_id) for r in rows if r.doc_id is None or r.doc_id >= 1000 if not contaminated(r.text))
    got = sorted(str(r.doc_id) for r in P.drop_contaminated(spark, docs.where("doc_id >= 1000 OR doc_id IS NULL"), "x").collect())
    assert got == want and "1000" not in want and "1100" not in want and "1200" in want


def test_pipeline_packs_every_document_that_is_left(spark, planted):
    import corpus_pipeline as P

    docs = planted[0]
    got = P.pack_sequences(spark, docs, "x").toPandas()
    assert {i for i in got.doc_id if i == i} == {r.doc_id for r in docs.where("doc_id IS NOT NULL").collect()}
    assert hashlib.sha256(str(sorted(got.columns)).encode()).hexdigest() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_shards_prune_on_every_dimension(spark, tmp_path):
    """Least and greatest values of the written files rule out more of them than files in the order of one column do, taken over all dimensions; rows survive."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from textbastion.llm.sharding import write_shards

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    dims = ["size", "lang", "source", "doc_id"]
    write_shards(docs, dims, str(tmp_path / "curve"), 32)
    docs.repartitionByRange(32, "doc_id").write.parquet(str(tmp_path / "flat"))
    values = {c: [r[0] for r in docs.where(F.col(c).isNotNull()).select(c).distinct().orderBy(F.rand(1)).limit(20).collect()] for c in dims}

    def skipped(path):
        out = {c: [] for c in dims}
        for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
            t = pq.read_table(f, columns=dims)
            for c in dims:
                x = [v for v in t.column(c).to_pylist() if v is not None]
                out[c] += [not x or not min(x) <= v <= max(x) for v in values[c]]
        return {c: float(np.mean(v)) for c, v in out.items()}

    curve, flat = skipped(tmp_path / "curve"), skipped(tmp_path / "flat")
    assert min(curve.values()) > 0.2 and np.mean([curve[c] for c in dims if c != "doc_id"]) > np.mean([flat[c] for c in dims if c != "doc_id"]) + 0.2, (curve, flat)
    assert spark.read.parquet(str(tmp_path / "curve")).count() == docs.count()


def test_cuts_of_strings_count_every_row(spark):
    """Of a column with more values than the driver takes, the stretches are of like size over all rows, however few values hold them."""
    from textbastion.llm.sharding import string_cuts

    rng = np.random.default_rng(4)
    values = [f"{v:04x}é" for v in (rng.zipf(1.3, 6000) % 4096).tolist()] + [f"z{i}" for i in range(2000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in rng.permutation(np.array(values, object)).tolist()], "s string")
    given = sorted((v for v in values if v is not None), key=str.encode)
    seen, want = 0, []
    for v in sorted(set(given), key=str.encode):
        n = given.count(v)
        if (seen + n) * 8 // len(given) > seen * 8 // len(given) and seen + n < len(given):
            want.append(v)
        seen += n
    assert len(set(given)) > 64 and string_cuts(df, "s", 8, 64) == want
    few = df.where("s < '0004'")
    assert string_cuts(few, "s", 8, 64) == sorted({v for v in given if v < "0004"}, key=str.encode)[:-1]


def test_batches_to_python_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from textbastion.llm.common import BATCH, Scratch

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    before = spark.conf.get(BATCH, None)
    wide = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 20000) AS text").mapInArrow(sizes, "n long, bytes long")
    got = Scratch(spark).keep(wide).collect()
    assert sum(r.n for r in got) == 2000 and max(r.bytes for r in got) < 9 << 20
    assert spark.conf.get(BATCH, None) == before


def test_counting_repeated_tokens_holds_little():
    import tracemalloc

    import pyarrow as pa

    from textbastion.llm import jaccard_join
    from textbastion.llm.common import shingle_sets

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 2000))) for _ in range(900)]
    texts += [t + " more" for t in texts[:100]]  # 1996 tokens in common
    docs = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["text"]) for i in range(0, len(texts), 50)]

    def peak(batches):
        tracemalloc.start()
        try:
            return list(batches), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    sent, most = peak(jaccard_join.send_sets(iter(docs), 1))
    assert most < 70  # MB at two million tokens; 12 of them are what is sent
    assert len(sent) == 2
    counted, most = peak(jaccard_join.count_repeated(iter(sent), 1))
    assert most < 50
    got = {}
    for b in counted:
        for names, rep in zip(b.column("name").to_pylist(), b.column("rep").to_pylist()):
            got |= dict(zip(np.frombuffer(names, np.int64).tolist(), np.frombuffer(rep, np.int32).tolist()))
    name = lambda t: int.from_bytes(jaccard_join.signature(shingle_sets(pa.array([t]))[0])[:8], "little", signed=True)
    for i in range(100):
        # tokens of one half within a set count once
        assert all(1994 <= got[name(t)] <= 1997 for t in (texts[i], texts[900 + i]))
    # two tokens of one half may meet among two million, 2 ** 21 / 2 ** 32 for each
    assert sum(got.get(name(t), 0) for t in texts[100:900]) < 2000
