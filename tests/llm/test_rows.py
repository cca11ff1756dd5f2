"""Odd columns and values, hot rows, and results against independent computations."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import kd_shards, langid, mixing, pieces, tokenids, topk, toxicity

DIR = "/root/testdata/sf0.001"
MAPS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra map<string,int>, more array<map<int,string>>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_stages_keep_columns_of_maps(spark, docs):
    import corpus_pipeline

    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, {"b": 1, "a": r.doc_id}, [{1: "x"}]) for r in docs.limit(12).collect()]
    twins = [(1000, f"the same words come again here {i // 6}", "en", "s", 9, {"k": i % 3} if i % 4 else None, None) for i in range(24)]
    table = spark.createDataFrame(own + twins + own[:3] + twins[:5], MAPS).repartition(3)
    many = collections.Counter(map(str, (tuple(r) for r in table.collect())))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, DIR)
        got = [str(tuple(r[c] for c in table.columns)) for r in out.collect()]
        if name in ("language_id", "near_dedup", "source_mixing"):
            assert set(got) <= set(many), name
        if name == "near_dedup":
            assert max(collections.Counter(got).values()) == 1
    left = corpus_pipeline.near_dedup(spark, table.where("doc_id = 1000"), DIR).collect()
    assert len(left) == len({r.text for r in left}) == 4


def test_topk_of_large_values(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3.0, 4.0]), (3, [1e15, 1e15]), (4, [1e15, -1e15]), (50, [1.0, 1.0]), (100, [1e17, 1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = topk.quantised(df)
    got = collections.defaultdict(list)
    for r in topk.exact_topk(v, v.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    cut = lambda x: max(-topk.MOST, min(topk.MOST, x))
    ints = {i: [int(np.floor(cut(x * 256))) for x in e] for i, e in rows if i != 7}
    for q in (0, 50, 100):
        want = sorted((-cut(sum(a * b for a, b in zip(ints[q], e))), i) for i, e in ints.items() if i != q)[:3]
        assert got[q] == [(i, -s) for s, i in want]


def test_other_tokenizers_give_their_own_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World", "it's 12 o'clock\n\nok", "é😀 straße", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in tokenids.read_ids(tokenids.write_ids(df, tokenizer=path)).collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, tokenids.END] for i, t in enumerate(texts)}
    assert tokenids.WordIds(tokenids.default_tokenizer()).by_word and not tokenids.WordIds(path).by_word


def test_rows_without_an_id_go_to_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
        parts = tokenids.write_ids(df).select("part").distinct().count()
        assert parts > 1
        n = kd_shards.kd_shards(df, shards=3)
        assert sorted(r.slot for r in n.where("shard = 0").collect()) == list(range(n.where("shard = 0").count()))
        mixed = mixing.entropy_mix(df)
        assert mixed.count() == 4000
        plan = mixed._jdf.queryExecution().optimizedPlan().toString()
        assert "_sub" in plan and "xxhash64" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "bad words", "en")] * 500 + [(2, "good " * 100, "en"), (3, "fine", "de"), (4, None, None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, 0), (3, 0), (4, 0), (None, 1), (5, 1), (3, None)], "doc_id bigint, toxic int")
    got = sorted((r.doc_id, r.toxic) for r in toxicity.sample(docs, labels, 10, 10).collect())
    assert got == [(1, 1), (2, 0), (3, 0), (4, 0)]
    small = toxicity.sample(docs, labels, 10, 10, most_bytes=50).collect()
    assert {r.doc_id for r in small} <= {1, 3, 4} and sum(len(r.text or "") for r in small if r.toxic == 0) <= 50


ITALIAN = "il gatto della nostra vicina dorme sempre sopra il muro di pietra quando arriva la sera e nessuno gli dice niente perché anche lui deve riposare dopo una lunga giornata passata a guardare gli uccelli".split()


def test_languages_come_from_the_data(spark, docs):
    rng = np.random.default_rng(3)
    italian = [(10_000 + i, " ".join(rng.permutation(ITALIAN)), "it", "web", 0) for i in range(60)]
    few = [(20_000 + i, "qwx zzk vvq", "zz", "web", 0) for i in range(3)]
    both = docs.unionByName(spark.createDataFrame(italian + few, docs.schema))
    assert "it" in langid.languages_of(both) and "zz" not in langid.languages_of(both)
    found = langid.identify(langid.document_records(both), langid.train(both))
    got = collections.Counter(r.language for r in found.where("key.doc_id between 10000 and 19999").collect())
    assert got["it"] >= 58
    assert langid.languages_of(docs.limit(0)) == ()
    assert langid.identify(langid.document_records(docs.limit(3)), langid.train(docs.limit(0))).where("keep").count() == 0


def softmax(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def fused(records, model):
    """Posteriors by hand: records are (text, declared code, host, suffix)."""
    names = [*model.languages, langid.UNKNOWN]
    width = len(names)
    prior = np.array([(1 - langid.UNKNOWN_PRIOR) / (width - 1)] * (width - 1) + [langid.UNKNOWN_PRIOR])
    rows = []
    for text, declared, host, suffix in records:
        grams, cut = langid.evidence(text or "")
        ll = None
        if len(grams) and any(ch.isalpha() for ch in text or ""):
            ll = model.logs[grams].astype(np.float64).mean(axis=0) * min(len(grams), langid.EVIDENCE)
            ll[-1] += langid.CUT * cut
        rows.append((ll, declared, host, suffix, None if ll is None else softmax(ll + np.log(prior))))
    sure = [r for r in rows if r[0] is not None]
    kind = lambda d: d if d in model.languages else "other"
    seen = collections.Counter((kind(d), names[int(np.argmax(p))]) for _, d, _, _, p in sure if d is not None)
    kinds = [*model.languages, "other"]
    overall = (sum((p for *_, p in sure), np.zeros(width)) + 1 / width) / (len(sure) + 1)

    def shares(of, over):
        groups = collections.defaultdict(list)
        for r in sure:
            if of(r) is not None:
                groups[of(r)].append(r[4])
        return {k: (sum(v) + langid.STRENGTH * over(k)) / (len(v) + langid.STRENGTH) for k, v in groups.items()}

    parent = lambda h: h.split(".", 1)[1] if h.count(".") >= 2 else h if "." in h else h.rstrip("0123456789")
    parents = shares(lambda r: None if r[2] is None else parent(r[2]), lambda k: overall)
    hosts = shares(lambda r: r[2], lambda k: parents[parent(k)])
    suffixes = shares(lambda r: r[3], lambda k: overall)
    out = []
    for ll, declared, host, suffix, _ in rows:
        if ll is None:
            out.append((langid.UNKNOWN, 0.0))
            continue
        logs = ll + np.log(hosts.get(host, overall))
        if declared is not None:
            logs = logs + np.log([(seen[kind(declared), t] + 1 / len(kinds)) / (sum(seen[k, t] for k in kinds) + 1) for t in names])
        if suffix is not None:
            logs = logs + np.log(suffixes[suffix] / overall) if suffix in suffixes else logs
        p = softmax(logs)
        out.append((names[int(np.argmax(p))], float(p.max())))
    return out


@pytest.mark.parametrize("name", ["documents", "pages"])
def test_posteriors_by_hand(spark, docs, name):
    model = langid.train(docs)
    records = langid.document_records(docs) if name == "documents" else langid.page_records(spark.read.parquet(f"{DIR}/pages.parquet"))
    rows = records.select("key", "text", langid.code(F.col("declared")).alias("declared"), F.lower("host").alias("host"), F.lower("suffix").alias("suffix")).collect()
    want = collections.Counter((str(r.key), lang, round(p, 6)) for r, (lang, p) in zip(rows, fused([(r.text, r.declared, r.host, r.suffix) for r in rows], model)))
    got = collections.Counter((str(r.key), r.language, round(r.posterior, 6)) for r in langid.identify(records, model).collect())
    assert got == want and len(got) >= 50


def test_dropout_query_by_hand(spark, docs):
    p = pieces.Pieces(pieces.default_model(), 0.1, 9)
    want = {r.doc_id: p.encode(r.text or "", r.doc_id) for r in docs.collect()}
    for r in pieces.op9_merge_dropout(spark, DIR).collect():
        ids = np.asarray(want[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) and r.lossless


def test_mixing_rates_solve_the_dual(spark, docs):
    """Every source's rates are min(cap, exp(lambda * size / largest)) with the one lambda that meets its target, found by bisection."""
    found = mixing.entropy_mix(docs).collect()
    own = collections.defaultdict(list)
    for r in found:
        own[r.source_size, r.target].append((r["size"], r.rate))
    for (_, target), rows in own.items():
        size, rate = np.array(rows, float).T
        x, low, high = size / max(1, size.max()), -1e4, 1e4
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (low, lam) if (size * np.minimum(3.0, np.exp(np.minimum(50, lam * x)))).sum() > target else (lam, high)
        assert np.allclose(rate[size > 0], np.minimum(3.0, np.exp(np.minimum(50, lam * x)))[size > 0], rtol=1e-5)


def kd_tree(rows, leaves, first, out):
    """Shards by sorting: rows are (coordinates, tie, size, key)."""
    if leaves == 1 or not rows:
        out.update({r[3]: first for r in rows})
        return
    spread = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(4)]
    dim = max(range(4), key=lambda d: (spread[d], -d))
    key = lambda r: (r[0][dim] << kd_shards.TIE_BITS) | r[1]
    goal, total, cut = sum(r[2] for r in rows) * (leaves // 2) / leaves, 0, None
    groups = collections.Counter()
    for r in rows:
        groups[key(r)] += r[2]
    for k, w in sorted(groups.items()):
        if total + w >= goal:
            cut = k + (total + w - goal < goal - total)
            break
        total += w
    half = leaves // 2
    kd_tree([r for r in rows if key(r) < cut], half, first, out)
    kd_tree([r for r in rows if key(r) >= cut], leaves - half, first + half, out)


@pytest.mark.parametrize("shards", [1, 2, 7, 24, 300])
def test_kd_tree_by_sorting(spark, docs, shards):
    """Hashes come from Spark; coordinates, cuts and shards are found by hand."""
    low = lambda n: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(n).cast("string"), F.lit(""))), 40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit("kd"), "doc_id", crc), 64 - kd_shards.TIE_BITS)
    found = docs.select("doc_id", low("source").alias("s"), low("lang").alias("l"), (F.octet_length("text") + 8).alias("size"), F.log2(F.octet_length("text") + 8).alias("log"), tie.alias("tie")).collect()
    columns = [[float(r[n]) for r in found] for n in ("s", "l", "log", "doc_id")]
    top = float((1 << kd_shards.GRID_BITS) - 1)
    grid = [[int((v - min(c)) / (max(c) - min(c)) * top) for v in c] for c in columns]
    want = {}
    kd_tree([([g[i] for g in grid], r["tie"], r["size"], r["doc_id"]) for i, r in enumerate(found)], shards, 0, want)
    assert {r.doc_id: r.shard for r in kd_shards.kd_shards(docs, shards=shards).collect()} == want


def test_kd_cuts_are_weighted_quantiles(spark, docs):
    """Each shard's bytes come near its share: every cut on the way is off by less than a document."""
    got = kd_shards.kd_shards(docs, shards=8).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    largest, total = max(r["size"] for r in got), sum(sizes.values())
    assert set(sizes) == set(range(8)) and all(abs(s - total / 8) <= 2 * largest for s in sizes.values())
