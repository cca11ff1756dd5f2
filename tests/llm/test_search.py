"""Periodic runs, contextual personal data and ball-tree search against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tapeloom.llm import balltree, periodic, personal

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


# Operator 11


def runs_by_definition(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best[i, j + q] = min(q, best.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def contract_words(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_transform_is_exact():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 900, 40), rng.integers(0, 900, 20)
    x, y = np.zeros((2, 64), np.uint64), np.zeros((2, 64), np.uint64)
    x[:, :40], y[:, :20] = a, b
    got = periodic.backward(periodic.forward(x) * periodic.forward(y) % periodic.P)
    assert got[0, :59].tolist() == got[1, :59].tolist() == np.convolve(a, b).tolist()


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 5)):
            part = [rng.randint(0, rng.choice([1, 2, 5, 60])) for _ in range(rng.randint(0, 40))]
            words += part * rng.randint(1, 5) + part[: rng.randint(0, len(part))]
        got = periodic.find_runs(np.array(words, np.int64), len(words))
        assert [tuple(r) for r in got.tolist()] == runs_by_definition(words)


def test_runs_across_block_borders_and_long_runs():
    for q in (1, 2, 3, 5, 6, 7, 14, 15, 30, 31, 62, 63, 64, 127, 300):
        for length in {max(12, 2 * q), max(12, 2 * q) + 1, 7 * q + 3}:
            if length < max(12, 2 * q):
                continue
            for before in (0, 1, 3, 17):
                words = [10_000 + i for i in range(before)] + [i % q for i in range(length)] + [20_000 + i for i in range(5)]
                assert periodic.find_runs(np.array(words, np.int64), len(words)).tolist() == [[before, length, q]], (q, length, before)
    same = np.zeros(50_000, np.int64)
    assert periodic.find_runs(same, len(same)).tolist() == [[0, 50_000, 1]]
    short = np.arange(40) % 6
    assert periodic.find_runs(short[:11], 11).tolist() == []


def test_op11_by_definition(spark):
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, SF).collect()}
    rows = documents()
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = contract_words(doc_id, text)
        if len(words) > 1500:  # the definition is quadratic
            continue
        runs, r = runs_by_definition(words), got[doc_id]
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert some > 10


def test_op11_odd_rows(spark):
    unit = "a b c"  # a no-break space parts no words
    texts = [(None, "x " * 20), (1, None), (2, ""), (3, " \t\n "), (4, f"{unit} " * 8), (4, f"{unit} " * 8), (5, "é\x1cz " * 12)]
    df = spark.createDataFrame([(i, t, {"k": 1}, 7) for i, t in texts], "doc_id bigint, text string, runs map<string,int>, n_words int")
    got = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(df).collect())
    assert got == sorted([(-1, 20, [(0, 20, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), *[(4, 16, [(0, 16, 2)], unit)] * 2, (5, 12, [(0, 12, 1)], "é\x1cz")])
    assert periodic.periodic_runs(df.where("doc_id > 99")).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, least=5)


# Operator 12

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = [int(x) for x in match if x in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_op12_base_spans(spark):
    got = {r["doc_id"]: r for r in personal.op12_contextual_pii(spark, SF).collect()}
    rows = documents()
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        spans, r = base_spans(text), got[doc_id]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        some += len(spans)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"].startswith(listed)
    assert some > 5


def test_personal_data_of_random_texts(spark):
    rng = random.Random(11)
    parts = ["@", ".", "a", "b-c", "_", "+", "1", "23", "255", "256", "0", " ", "-", "(", ")", "é", "😀", "\n", "4785380592391139", "1.2.3.4", "x@y.z", "+1 (743) 555-3824"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", " ".join(f"a{i}@b.co +1 555 {i:07d}" for i in range(300)), "1 " * 3000]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[8])]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, email string")
    got = personal.personal_data(df).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, base_spans(t)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], [(k, s["start"], s["end"]) for k in PLAIN for s in r[k]]) for r in got) == want
    assert personal.personal_data(df.where("doc_id < 0")).collect() == []


def accepted_by_definition(mentions, rounds=personal.ROUNDS):
    """mentions: (class, instance, kind or None, patterns)."""
    links = {((c, p), (c, i)) for c, i, _, ps in mentions for p in ps}
    seeds = {((c, i), k): 1.0 for c, i, k, _ in mentions if k}
    known = {i for i, _ in seeds}
    scores = dict(seeds)
    for _ in range(rounds):
        sure = {}
        for p in {p for p, _ in links}:
            after = {i for q, i in links if q == p}
            for k in {k for _, k in scores}:
                votes = [scores[i, k] for i in after if (i, k) in scores]
                if sum(v >= personal.ACCEPT for v in votes) >= personal.SUPPORT and sum(votes) / (len(after) + personal.PRIOR) >= personal.SURE:
                    sure[p, k] = sum(votes) / (len(after) + personal.PRIOR)
        scores = dict(seeds)
        for i in {i for _, i in links} - known:
            for k in {k for _, k in sure}:
                doubt = 1.0
                for p in {p for p, j in links if j == i}:
                    doubt *= 1 - sure.get((p, k), 0.0)
                if 1 - doubt >= personal.ACCEPT:
                    scores[i, k] = 1 - doubt
    return {(i[0], i[1], k): s for (i, k), s in scores.items() if i not in known}


def test_bootstrap_by_definition(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    mentions = []
    for i in range(160):
        kind = rng.choice(["phone", "phone", "card", None])
        lead = rng.choice(words[:2]) if kind == "phone" else rng.choice(words[2:4]) if kind == "card" else rng.choice(words)
        mentions.append(("number", f"{1000 + (i if kind else i % 40)}", kind, [lead, f"{rng.choice('ab')} {lead}"]))
    df = spark.createDataFrame(mentions, "class string, instance string, kind string, patterns array<string>")
    want = accepted_by_definition(mentions)
    got = {(*r["instance"].split(":", 1), r["kind"]): r["score"] for r in personal.bootstrap(df).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_patterns_discover_identifiers(spark):
    rows = [(i, f"reach the clerk by phone at +1 (2{i:02d}) 555-01{i:02d} today") for i in range(12)]
    rows += [(100, "reach the clerk by phone at 5552223344 today"), (101, "unrelated 555.222.3344 here"), (102, "unrelated 5559990000 here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["phone_like"] for r in personal.personal_data(df).where("doc_id >= 100").collect()}
    assert [tuple(s) for s in got[100]] == [(28, 38)] and [tuple(s) for s in got[101]] == [(10, 22)] and got[102] == []


# Operator 13


def test_op13_equals_sql(spark):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(duckdb.sql(balltree.OP13_SQL).fetchall())
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in balltree.op13_ball_tree_search(spark, SF).collect())
    assert got == want and len(got) > 50


def test_ball_tree_is_exact_and_prunes(monkeypatch):
    rng = np.random.default_rng(8)
    weight = rng.integers(0, 9000, 300)
    topics = [np.unique(rng.integers(0, 300, 40)) for _ in range(12)]
    docs = [np.unique(rng.choice(topics[i % 12], rng.integers(1, 40))) for i in range(1500)]
    docs += [np.unique(rng.integers(0, 300, rng.integers(1, 60))) for _ in range(300)] + [np.array([7, 8, 9])] * 200
    sizes, terms = np.array([len(d) for d in docs]), np.concatenate(docs)
    impacts = rng.integers(1, 1_000_000, len(terms))
    impacts[-600:] = np.tile([500_000, 400_000, 300_000], 200)
    tree, scratch = balltree.BallTree(list(range(len(docs))), sizes, terms, impacts, weight), np.zeros(300, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Every node's ball holds its documents.
    at = np.repeat(np.arange(len(docs)), sizes)
    x = np.zeros((len(docs), 300))
    x[at, terms] = impacts.astype(float) * weight[terms]

    def below(node):
        return tree.leaves[node][0].tolist() if tree.below[node] is None else [i for child in tree.below[node] for i in below(child)]

    for node in range(len(tree.centres)):
        away = x[below(node)] - tree.centre[node].astype(float)
        assert np.sqrt((away**2).sum(1)).max() <= tree.radius[node] and (away <= tree.reach[node] * (1 + 1e-6) + 1e-3).all()
    scored, real = [], np.add.reduceat

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:  # noqa: N801
            @staticmethod
            def reduceat(v, starts):
                scored.append(len(starts))
                return real(v, starts)

    monkeypatch.setattr(balltree, "np", Counting())
    for i in range(60):
        asked = np.unique(rng.choice(topics[i % 12], 6))
        counts = rng.integers(1, 4, len(asked))
        y = np.zeros(300, np.int64)
        y[asked] = counts * weight[asked]
        score = real(y[terms] * impacts, first)
        want = sorted((-int(s), False, i) for i, s in enumerate(score) if s > 0)[:10]
        assert tree.search(asked, counts, scratch, [], 10) == want and not scratch.any()
    assert 0 < sum(scored) < 0.8 * 60 * len(docs)


def test_ranked_search_odd_rows(spark, monkeypatch):
    docs = [(3, "Red fox"), (1, "red FOX"), (None, "red fox"), (2, "red fox"), (2, "red fox"), (4, None), (5, ""), (6, "..."), (7, "blue " * 50 + "fox"), (8, "İ i"), (9, "naïve")]
    df = spark.createDataFrame([(i, t, i, "q") for i, t in docs], "doc_id bigint, text string, rank bigint, item string")
    items = spark.createDataFrame([(1, "RED"), (2, None), (3, "nothing"), (1, "RED"), (None, "naïve"), (4, "İ"), (5, "--")], "item_id int, text string")
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in balltree.ranked_search(df, items, k=4).collect()]
    red = [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted([*red, *red, (None, 1, 9), (4, 1, 8)], key=key)
    assert [r["doc_id"] for r in balltree.ranked_search(df, items.where("item_id = 1").distinct(), k=9).orderBy("rank").collect()] == [1, 2, 2, 3, None]
    monkeypatch.setattr(balltree, "ITEMS", 1)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"]) for r in balltree.ranked_search(df, items, k=4).collect()), key=key) == sorted(got, key=key)
    assert balltree.ranked_search(df.limit(0), items).collect() == [] and balltree.ranked_search(df, items.limit(0)).collect() == []
