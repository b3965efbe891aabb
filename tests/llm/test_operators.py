"""Corpus operators against brute force, round trips and held-out accuracy, over whole small tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").toPandas()


def smallest(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in low.translate({c: " " for c in range(9, 14)}).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(pairs_of):
    links = []
    ids = list(pairs_of)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(pairs_of[a] & pairs_of[b])
            if both and 100 * both >= 75 * len(pairs_of[a] | pairs_of[b]):
                links.append((a, b))
    return smallest(ids, links)


def test_jaccard_join_is_exact(spark, docs):
    from textbastion.llm.jaccard_join import op1_ngram_jaccard_join

    sets = {int(i): shingles(t) for i, t in zip(docs.doc_id, docs.text)}
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_jaccard_join(spark, DIR).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_join_defined_cases(spark):
    from textbastion.llm.jaccard_join import near_duplicates

    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "one two"), (7, "x " * 30_000), (8, "x " * 30_001)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), None: (1, 4), 7: (1, 7), 8: (1, 7)}


def test_substring_dedup_is_exact(spark, docs):
    from textbastion.llm.substring_dedup import op3_suffix_dedup

    body = {int(i): (t or "").encode() for i, t in zip(docs.doc_id, docs.text)}
    n = defaultdict(int)
    for b in body.values():
        for i in range(len(b) - 199):
            n[hash(b[i : i + 200])] += 1
    want = {}
    for d, b in body.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if n[hash(b[i : i + 200])] > 1:
                gone[i] += 1
                gone[min(i + 200, len(b))] -= 1
        out = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], out.astype(int)))) == 1).sum())
        want[d] = (len(b), int(out.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~out])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, DIR).collect()}
    assert got == want


def test_embedding_links(spark):
    from textbastion.llm.embedding_dedup import op8_embedding_dedup

    e = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in op8_embedding_dedup(spark, DIR).collect()}
    assert len(got) == len(e)
    found, true = sum(r.n_links for r in got.values()), int(close.sum())
    assert found >= 0.9 * true and all(got[i].n_links <= n for i, n in zip(e.vec_id, close.sum(1)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from textbastion.llm.packing import op10_best_fit_packing
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {int(i): t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in zip(docs.doc_id, docs.text)}
    rows = op10_best_fit_packing(spark, DIR).collect()
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.length <= 2048
    assert set(per_doc) == set(ids)
    for d, rs in per_doc.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) and sum(r.length for r in rs) == len(ids[d])
        assert all(r.length == 2048 for r in rs[1:]) and (len(rs) == 1) == (len(ids[d]) <= 2048)
    for rs in per_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(per_seq) <= 1.05 * -(-total // 2048) + 1


def test_sharding_laws(spark, docs):
    from textbastion.llm.sharding import op9_hilbert_sharding

    rows = op9_hilbert_sharding(spark, DIR).collect()
    by = {int(i): (t or "").encode() for i, t in zip(docs.doc_id, docs.text)}
    assert len(rows) == len(by) and len({r.law for r in rows}) == 1
    shards = defaultdict(list)
    for r in rows:
        assert r.size == len(by[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(by[r.doc_id])
        shards[r.shard].append(r)
    assert set(shards) <= set(range(8))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in shards.values())


def test_held_out_accuracy(spark, docs):
    from textbastion.llm.langid import op4_language_id
    from textbastion.llm.toxicity import op2_toxicity

    big = DIR.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op4_language_id(spark, big).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [r for r in op2_toxicity(spark, big).collect() if r.held_out and r.doc_id in toxic]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)
    pos, neg = ([r.score for r in held if toxic[r.doc_id] == k] for k in (1, 0))
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    print("toxicity AUC", auc, len(pos), len(neg))
    assert auc > 0.8


def test_decontamination_plants(spark):
    from textbastion.llm.decontamination import find_contamination

    item = " ".join(f"term{i * i % 97}x{i}" for i in range(80))
    changed = " ".join("other" if i == 40 else w for i, w in enumerate(item.split()))
    rows = [(1, f"some text before {item} and after"), (2, "a clean text about nothing in particular " * 5), (3, changed), (4, None), (5, "")]
    got = {r.doc_id: len(r.hits) for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1] > 0 and got[3] > 0 and got[2] == got[4] == got[5] == 0


def test_line_dedup_and_hosts_match_sql(spark):
    import duckdb
    from textbastion.llm import registry

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    for name, sql in registry.ORACLE_SQL.items():
        a, b = registry.QUERIES[name](spark, DIR).toPandas(), c.execute(sql).df()
        cols = sorted(b.columns)
        norm = lambda d: sorted(tuple("~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
        assert norm(a) == norm(b), name


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    kept = corpus_pipeline.run(spark, DIR).select("doc_id").distinct().count()
    assert 0.5 * n < kept < n


def key_of(line):
    return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})


def brute_line_dedup(texts):
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(i)
    common = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if common.get(key_of(x), i) == i) for i, t in texts.items()}


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    source = spark.read.parquet(f"{DIR}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    df = source
    for name, stage in list(stages.items())[:-1]:
        stage(spark, df, DIR).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.columns == source.columns
        seen[name] = texts(df)
    before = texts(source)
    assert seen["toxicity"] == {i: before[i] for i in seen["toxicity"]}
    assert seen["line_dedup"] == brute_line_dedup(seen["toxicity"])
    comp = brute_components({i: shingles(t) for i, t in seen["line_dedup"].items()})
    assert seen["ngram_jaccard_join"] == {i: t for i, t in seen["line_dedup"].items() if comp[i] == i}
    assert seen["benchmark_decontamination"] == {i: seen["ngram_jaccard_join"][i] for i in seen["benchmark_decontamination"]}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, DIR).select("doc_id").distinct().collect()}
    assert packed == set(seen["benchmark_decontamination"])


def test_jaccard_join_groups_of_near_copies(spark):
    """Copies that each differ in places of their own: the least frequent shingles of each are its own."""
    from textbastion.llm.jaccard_join import near_duplicates

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, i % 5):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    want = brute_components({i: shingles(t) for i, t in rows})
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def brute_links(sets):
    """n_links of each document by comparing all pairs."""
    n = dict.fromkeys(sets, 0)
    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
    return n


def near_group(rng, size, words, most, first=0):
    """Texts that each replace, drop or add some words of one text."""
    base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    out = {}
    for i in range(size):
        w = list(base)
        for _ in range(int(rng.integers(0, most + 1))):
            at = int(rng.integers(0, len(w)))
            kind = int(rng.integers(0, 3))
            w[at : at + 1] = [[f"n{int(rng.integers(0, 50))}"], [], [w[at], "extra"]][kind]
        out[first + i] = " ".join(w)
    return out


def test_jaccard_join_counts_links_within_near_groups(spark, monkeypatch):
    from textbastion.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rng = np.random.default_rng(5)
    texts = near_group(rng, 150, 120, 9) | near_group(rng, 60, 30, 4, 200) | near_group(rng, 100, 400, 40, 300)
    texts |= {500 + i: texts[i] for i in range(20)}
    sets = {i: shingles(t) for i, t in texts.items()}
    want, links = brute_components(sets), brute_links(sets)
    got = jaccard_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (want[i], links[i]) for i in texts}


def test_words_of_a_regular_build_do_not_collide(spark):
    from textbastion.llm.jaccard_join import near_duplicates

    a = "a"
    for _ in range(12):
        a += a.translate({97: 98, 98: 97})
    rows, ids = [], 0
    for size in (1024, 2048, 4096):
        for w in (a[:size], a[:size].translate({97: 98, 98: 97})):
            rows.append((ids, f"one two three {w}"))
            ids += 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in got)


def test_line_dedup_by_broadcast_and_by_shard_tasks(spark, monkeypatch):
    from textbastion.llm import line_dedup

    rng = np.random.default_rng(3)
    pool = [f"  Line {i} is a long enough passage to be a KEY of its own {i * 7}" for i in range(300)]
    rows = [(None, pool[0] + "\nx"), (None, None), (3, ""), (3, pool[1] + "\n" + pool[1])]
    for d in range(4, 120):
        rows.append((d, "\n".join([pool[0], *(pool[int(i)] + " " * int(i % 3) for i in rng.zipf(1.3, 12) % 300), f"tail {d}"])))
    rows += rows[5:9]
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, n_lines string, __gone int")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(-1 if rows[i][0] is None else rows[i][0])
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(k := key(x)) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != (-1 if d is None else d))]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    monkeypatch.setattr(line_dedup, "PER_SHARD", 7)
    monkeypatch.setattr(line_dedup, "PER_SALT", 50)
    order = lambda x: sorted(x, key=str)
    for mb in (64, -1):
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, broadcast_mb=mb).collect()]
        assert order(got) == order(want)
        assert line_dedup.dedup_lines(docs.limit(0), broadcast_mb=mb).collect() == []


def test_perfect_hash_of_keys_that_share_half_their_hash():
    from textbastion.llm.line_dedup import Shards, build_shard

    rng = np.random.default_rng(1)
    h, fp = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    h[:1000] = np.repeat(h[:200], 5)
    fp[1000:2000] = fp[1000]
    body = build_shard(h, fp, np.arange(5000), np.arange(5000))
    held = Shards({0: body}, 1)
    hit, last = held.probe(h, fp)
    assert hit.all() and (last == np.arange(5000)).all() and (np.sort(held.ids) == np.arange(5000)).all()
    assert not held.probe(h, rng.integers(0, 1 << 63, 5000).astype(np.uint64))[0].any()


def test_language_of_a_text_does_not_depend_on_its_slice(docs):
    import pyarrow as pa

    from textbastion.llm import langid

    texts = [t or "" for t in docs.text]
    texts += [a[:300] + " " + b[:300] for a, b in zip(texts, texts[7:])]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t)], ["text"])
    langs = sorted({x for x in docs.lang if x})
    counts = np.full((langid.BUCKETS, len(langs)), 0.5)
    for t, lang in zip(docs.text, docs.lang):
        if lang and t:
            keys, n = langid.grams(batch([t]))
            counts[keys % langid.BUCKETS, langs.index(lang)] += n
    model = langid.Model(langs, (counts / counts.sum(0)).astype(np.float32))
    together = model.infer(*langid.grams(batch(texts)), len(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], model.infer(*langid.grams(batch([t])), 1)[0], atol=1e-5)


def test_embedding_dedup_in_groups_and_with_repeated_ids(spark):
    from textbastion.llm.embedding_dedup import dedup_embeddings

    rng = np.random.default_rng(11)
    base = rng.standard_normal((3, 24))
    vecs = [base[0] + 0.35 * rng.standard_normal(24) for _ in range(400)] + [base[1] + 0.1 * rng.standard_normal(24) for _ in range(150)] + [base[1]] * 30
    vecs += [base[2] + 0.5 * rng.standard_normal(24) for _ in range(60)] + list(rng.standard_normal((500, 24)))
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(5, rows[0][1]), (5, rows[450][1]), (7000, None), (7001, [0.0] * 24), (7002, [float("nan")] * 24), (7003, [1.0, None]), (7004, [1.0, 0.0]), (None, rows[3][1])]
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 7000]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = x @ x.T >= 0.9
    got = dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n = {}
    for r in got:
        n.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(rows) and all(n[i][0].n_links == 0 and n[i][0].component_id == i for i in (7000, 7001, 7002, 7003, 7004)) and n[None][0].component_id is None
    want = link.sum(1) - 1
    have = sum(r.n_links for r in got)
    assert 0.97 * want.sum() <= have <= want.sum()
    at = smallest(range(len(good)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(link, 1))])
    low = {}
    for i, (v, _) in enumerate(good):
        low[at[i]] = min(low.get(at[i], v), v)
    right = sum(any(r.component_id == low[at[i]] for r in n[v]) for i, (v, _) in enumerate(good))
    assert right >= 0.98 * len(good)
    big = sorted(r.n_links for i in range(550, 580) for r in n[i])
    assert big == sorted(want[550:580].tolist())
    assert dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_embedding_components_at_a_larger_size(spark):
    from textbastion.llm.embedding_dedup import op8_embedding_dedup

    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x = np.stack(t.embedding).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    ids = t.vec_id.tolist()
    at = smallest(ids, [(ids[a], ids[b]) for a, b in np.argwhere(np.triu(link, 1))])
    got = {r.vec_id: r for r in op8_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert sum(r.n_links for r in got.values()) >= 0.98 * (link.sum() - len(ids))
    assert all(got[i].n_links <= n for i, n in zip(ids, (link.sum(1) - 1).tolist()))
    assert sum(got[i].component_id == at[i] for i in ids) >= 0.98 * len(ids)


def test_toxicity_counts_document_frequencies_over_all_documents(spark):
    import pyarrow as pa
    from textbastion.llm import toxicity

    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.select("text").collect()]
    h, first = toxicity.terms(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))
    own = [set(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    df, total = toxicity.frequencies(docs, index.vocabulary)
    assert total == len(texts) and df.tolist() == [sum(int(t) in x for x in own) for t in index.vocabulary]


def test_toxicity_finds_the_nearest_examples_exactly(spark):
    """Block-max skipping against all cosines by dense vectors; equal scores for equal texts; the defined cases."""
    import pyarrow as pa
    from textbastion.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.select("text").limit(300).collect()] + [None, "", "unheardofword"]
    first, term, w = index.vectorise(*toxicity.terms(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])))
    v = len(index.vocabulary)
    examples = np.zeros((len(index.toxic), v))
    for b, (known, column, matrix, starts, example, weight) in enumerate(index.blocks):
        for i, t in enumerate(known.tolist()):
            if column[i] >= 0:
                rows = b * 64 + np.flatnonzero(matrix[column[i]])
                examples[rows, t] = matrix[column[i]][rows - b * 64]
            else:
                examples[b * 64 + example[starts[i] : starts[i + 1]].astype(int), t] = weight[starts[i] : starts[i + 1]]
    sims, kth = index.nearest(first, term, w)
    for i in range(len(texts)):
        q = np.zeros(v)
        q[term[first[i] : first[i + 1]]] = w[first[i] : first[i + 1]]
        full = examples @ q
        want = np.sort(full)[-index.k]
        assert abs(kth[i] - max(want, 0)) < 1e-5
        reach = full > want + 1e-5
        assert np.allclose(sims[i][reach], full[reach], atol=1e-5)
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "y"), (None, texts[0], "z")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), index).collect()
    assert len(got) == 4 and all(0 <= r.toxicity <= 1 for r in got) and got[0].toxicity == got[1].toxicity
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.toxicity for r in toxicity.score(docs.limit(5), empty).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), index).collect() == []


def test_toxicity_is_calibrated(spark):
    """On held-out rows, the share of toxic ones is near the mean score, overall and on either side of one half."""
    from textbastion.llm.toxicity import op2_toxicity

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    got = [(r.score, labels[r.doc_id]) for r in op2_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    s, y = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    for part in (s >= 0, s < 0.5, s >= 0.5):
        assert abs(s[part].mean() - y[part].mean()) < 0.08, (s[part].mean(), y[part].mean(), part.sum())


def test_toxicity_index_is_built_and_kept_off_the_driver(spark):
    """The stage's fit takes little on the driver beside the open index, which is several times smaller than what it is built from, and builds the same index as the driver does from the same rows."""
    import tracemalloc

    import corpus_pipeline as P
    from textbastion.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    size = index.maxima.nbytes + sum(x.nbytes for b in index.blocks for x in b)
    tracemalloc.start()
    stage = P.drop_toxic(spark, docs, sf)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * size, (most, size)
    assert 0 < stage.limit(500).count() <= 500
    rows, share = toxicity.sample(docs, labels, 4096, 32 << 20)
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, r.h))
    own = [np.frombuffer(r.h, np.uint64) for r in rows]
    voc = np.unique(np.concatenate(own))
    want = toxicity.learn([r.doc_id for r in rows], np.array([r.toxic > 0 for r in rows]), own, [np.frombuffer(r.n, np.int32) for r in rows], voc, *toxicity.frequencies(docs, voc), share, index.k)
    for name in ("vocabulary", "weight", "maxima", "toxic", "stands", "ids"):
        assert np.array_equal(getattr(index, name), getattr(want, name)), name
    assert all(np.array_equal(x, y) for a, b in zip(index.blocks, want.blocks, strict=True) for x, y in zip(a, b, strict=True))
    # votes are sums of single-precision products, whose order is that of the machine's threads
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(index.curve, want.curve))
