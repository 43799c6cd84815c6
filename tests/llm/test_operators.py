"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, and
columns whose names clash."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from talkspan.llm import common, hnsw, licenses, linededup, mixing, pieces, quality, secrets, simhash, tokencounts, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, range int, size int, h1 string, target string"


def docs(spark, rows):
    """Documents of (doc_id, text, source) with further columns whose names operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "k", 1, 2, "h", "t") for i, t, s in rows]
    return spark.createDataFrame(full, DOC)


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = ["alpha", "Beta", "gamma,", "delta.", "époque", "zeta", "eta", "theta!", "日本", "kappa", "lambda", "mu", "nu", "xi"]
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "only text", "b"), (5, "one", None), (5, "one", None), (7, "x" * 50_000 + " y" * 20_000, "a")]


def edge_docs(spark, n=30, seed=1):
    rng = random.Random(seed)
    rows = ODD + [(10 + i, text_of(rng, rng.randint(1, 80)), rng.choice(["a", "a", "a", "b", "é"])) for i in range(n)]
    return docs(spark, rows + rows[-3:]), rows + rows[-3:]


def plain(text):
    return (text or "").encode().lower().split()


def union_find(pairs, items):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(0, 5000 + i) for i in range(300)] + [(3, 3), (None, 4)]
    want = union_find([e for e in edges if None not in e], {x for e in edges for x in e if x is not None})
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_quality_held_out(spark):
    rng = random.Random(3)
    rows, grades = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 200))]
        g = rng.choice([0, 1, 2, 2, 2])
        if g == 0:
            words = [w + "***" for w in words]
        if g == 1:
            words[rng.randrange(len(words))] = rng.choice(["awful", "nasty", "rude"])
            words[rng.randrange(len(words))] = rng.choice(["awful", "nasty", "rude"])
        rows.append((i, " ".join(words), "s"))
        grades.append((i, g))
    d = docs(spark, rows)
    model = quality.train(d, spark.createDataFrame([x for x in grades if x[0] < 1200] + [(None, 1), (3, None)], "doc_id long, grade int"))
    assert model.thresholds[0] < model.thresholds[1]
    out = {r.doc_id: r for r in quality.score(d, model).collect()}
    held = [(out[i].keep, g == 2) for i, g in grades if i >= 1200]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    mean = lambda k: np.mean([out[i].expected_grade for i, g in grades if g == k])
    assert mean(0) < mean(1) < mean(2)
    assert quality.select(d, model).count() == sum(r.keep for r in out.values())


def test_quality_edges(spark):
    d, rows = edge_docs(spark)
    empty = spark.createDataFrame([], "doc_id long, grade int")
    out = quality.score(d, quality.train(d, empty)).collect()
    assert len(out) == len(rows) and len({r.tail_prob for r in out}) == 1
    assert quality.score(docs(spark, []), quality.train(docs(spark, []), empty)).count() == 0


def test_fit_is_the_penalised_maximum():
    """The fitted model against plain gradient descent with numeric derivatives on the likelihood written out."""
    rng = np.random.default_rng(0)
    used, n = [5, 77, 1000], 160
    on = rng.random((n, 3)) < 0.5
    grades = np.clip(np.round(1 + on @ [1.2, -0.9, 0.2] - 0.3 + 0.7 * rng.normal(size=n)), 0, 2).astype(int)
    l2 = 0.5
    m = quality.fit([np.array(used, np.int32)[r] for r in on], grades, 3, l2=l2, rounds=2000, rate=0.05)

    def loss(w, t):
        total = 0.0
        for row, k in zip(on, grades, strict=True):
            s = sum(a for a, o in zip(w, row, strict=True) if o)
            below = [0.0, *(1 / (1 + math.exp(s - c)) for c in t), 1.0]
            total -= math.log(below[k + 1] - below[k])
        return total / n + 0.5 * l2 * sum(a * a for a in w) / math.sqrt(n)

    x = np.array([0.0, 0.0, 0.0, -1.0, 1.0])
    at = lambda v: loss(v[:3], v[3:])
    for _ in range(600):
        x = x - 1.0 * np.array([(at(x + 1e-5 * e) - at(x - 1e-5 * e)) / 2e-5 for e in np.eye(5)])
    assert np.allclose(m.weights[used], x[:3], atol=0.01) and np.allclose(m.thresholds, x[3:], atol=0.01)
    assert np.count_nonzero(m.weights) == 3


# --- 2


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, rule):
    d, rows = edge_docs(spark)
    out = tokencounts.count(d, rule=rule).collect()
    assert len(out) == len(rows)
    want = sorted((repr(i), len(tokencounts.token_spans(t or "")[0]), (t or "").count("\n") + 1) for i, t, _ in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, len(r.tokens)) for r in out) == want
    assert all(math.isclose(sum(r.tokens), r.n_tokens) for r in out)
    assert tokencounts.count(docs(spark, []), rule=rule).count() == 0


def test_token_spans_and_rules(spark):
    for text in ("Hello wörld, 日本語 🎉!", "", "a\n\nb", "🎉🎉"):
        s, e = tokencounts.token_spans(text)
        enc, _ = tokencounts.encoding(tokencounts.RANKS)
        parts = [enc.decode_single_token_bytes(t) for t in enc.encode_ordinary(text)]
        at = 0
        for part, a, b in zip(parts, s, e, strict=True):
            begun = lambda n: len(text.encode()[:n].decode("utf-8", "ignore"))
            assert a == begun(at) or (text.encode()[at] & 0xC0) == 0x80 and a == begun(at)
            at += len(part)
            assert b == begun(at) or b == begun(at) + 1
    ends = np.array([3, 6])
    s, e = np.array([0, 2, 5]), np.array([2, 5, 6])  # the second crosses: one character before, two after
    assert tokencounts.attribute(s, e, ends, "first")[0].tolist() == [2, 1]
    assert tokencounts.attribute(s, e, ends, "most")[0].tolist() == [1, 2]
    assert np.allclose(tokencounts.attribute(s, e, ends, "split")[0], [4 / 3, 5 / 3])
    f = tokencounts.count_fields(spark.createDataFrame([(1, "Hello", None, "bye now")], "id long, a string, b string, c string"), ["a", "b", "c"], "id").first()
    assert sum(f.tokens) == f.n_tokens and len(f.tokens) == 3


def brute_attribution(text, ends, rule):
    """Tokens of sections, by walking characters: a token holds those that its bytes begin, or the one they continue."""
    enc, _ = tokencounts.encoding(tokencounts.RANKS)
    owner = [n for n, c in enumerate(text) for _ in c.encode()]  # of each byte
    section = lambda c: next((k for k, e in enumerate(ends) if c < e), len(ends) - 1)
    raw, at, out = text.encode(), 0, [0.0] * len(ends)
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        held = sorted({owner[b] for b in range(at, at + size)})
        at += size
        parts = [section(c) for c in held]
        if rule == "first":
            out[parts[0]] += 1
        elif rule == "most":
            out[max(sorted(set(parts)), key=parts.count)] += 1
        else:
            for k in parts:
                out[k] += 1 / len(parts)
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_attribution_of_whole_texts(spark, rule):
    """Lines and sections cut anywhere, of real texts, against a walk over their characters."""
    rng = random.Random(13)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and length(text) < 6000").orderBy("doc_id").select("text").limit(60).collect()]
    texts += ["日本語\n  \n\n\nétude 🎉🎉\n x", "a\n\n\n\nb\r\n\tc", "🎉日本"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.tokens for r in tokencounts.count(docs(spark, rows), rule=rule).collect()}
    for i, t, _ in rows:
        ends = [n + 1 for n, c in enumerate(t) if c == "\n"] + [len(t) + 1]
        assert np.allclose(got[i], brute_attribution(t, ends, rule)), i
    cuts = [sorted(rng.sample(range(1, len(t) + 1), min(len(t), 7))) for t in texts]
    d = spark.createDataFrame([(i, t, c) for (i, t, _), c in zip(rows, cuts, strict=True)], "doc_id long, text string, ends array<int>")
    got = {r.doc_id: r.tokens for r in tokencounts.count(d, F.col("ends"), rule=rule).collect()}
    for (i, t, _), c in zip(rows, cuts, strict=True):
        assert np.allclose(got[i], brute_attribution(t, c, rule)), i


# --- 3


def base_spans(text):
    out = []
    for k, (name, pattern, least) in enumerate([("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32)]):
        p = re.compile(pattern.replace("(?:", "(?i:", 1) if k == 0 else pattern, re.A)
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text) if len(m[1]) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    rng = random.Random(5)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = ODD + [
        (20, "日本 token: secret: abcdefghij and PassWord = 'hunter2hunter2'", "a"), (21, "é AKIA" + key(16, "ABC123") + " AKIA12 xAKIAAKIA" + key(12, "Z9"), "a"),
        (22, "0" * 31 + " " + key(40, "0123456789abcdef") + "g" + key(32, "0123456789abcdef"), "a"), (23, "Api_Key=\"" + key(9, b64) + "\"token==" + key(9, b64), "a"),
        (24, "see " + key(44, b64) + " here", "a"), (25, "internationalisation " * 40 + "TheQuickBrownFoxJumpsOverTheLazyDogAndRunsAway", "a"),
    ]
    rows += [(30 + i, f"AnotherVeryLongCamelCaseIdentifierNumber{i} words", "b") for i in range(20)]
    out = secrets.scan(docs(spark, rows)).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r.spans)
    assert len(out) == len(rows)
    for i, t, _ in rows:
        assert [f"{s.name}:{s.start}:{s.end}" for s in got[i][0] if s.kind < 3] == base_spans(t or ""), i
    found = {i for i, s in got.items() if any(x.name == "random" for x in s[0])}
    assert found == {24}
    assert secrets.scan(docs(spark, [])).count() == 0


def test_random_spans_precision_and_recall(spark):
    """Planted keys of several encodings and lengths among ordinary long tokens."""
    rng = random.Random(21)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["account", "Server", "latest", "value", "Upper", "handle", "content", "internal", "Service", "manager", "uploads", "request", "window", "network", "default", "session"]
    rows, keys, ordinary = [], {}, {}
    for i in range(400):
        token, kind = None, i % 4
        if kind == 0:
            n = rng.choice([20, 24, 32, 40, 64])
            token = "".join(rng.choice(rng.choice([b62, b62 + "+/"])) for _ in range(n))
            keys[i] = token
        elif kind == 1:
            token = "".join(w.title() for w in rng.sample(words, 4)) + str(rng.randrange(100))
        elif kind == 2:
            token = rng.choice("-_/").join(rng.sample(words, 4))
        if token and i not in keys:
            ordinary[i] = token
        text = " ".join(rng.choice(words) for _ in range(60))
        rows.append((i, f"{text} {token or ''} {text}", "a"))
    out = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secrets.scan(docs(spark, rows)).collect()}
    text = {i: t for i, t, _ in rows}
    found = {i for i, s in out.items() if s}
    assert all(text[i][s.start : s.end] == keys[i] for i in found & set(keys) for s in out[i])
    long = {i for i, k in keys.items() if len(k) >= 32}
    assert len(found & set(keys)) >= 0.75 * len(keys) and len(found & long) >= 0.95 * len(long)
    assert len(found - set(keys)) <= 0.03 * len(found)


def test_many_spans_in_one_text(spark):
    """Spans are told in time that grows with their number, and overlaps with them too."""
    import time

    rng = random.Random(22)
    pieces_ = []
    for _ in range(20_000):
        pieces_.append("".join(rng.choice("0123456789abcdef") for _ in range(33)) + " x ")
        pieces_.append("AnotherCamelCaseName" + str(rng.randrange(10**6)) + " ")
    text = "".join(pieces_)
    began = time.time()
    (r,) = secrets.scan(docs(spark, [(1, text, "a")])).collect()
    assert [f"{s.name}:{s.start}:{s.end}" for s in r.spans if s.kind < 3] == base_spans(text)
    assert time.time() - began < 60


# --- 4


def brute_topk(rows, k):
    """(query id, rank, id, score) by rows, not ids: every row but the query's own is a candidate."""
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(fit):
        if i is not None and i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), math.inf if j is None else j) for m, (j, v) in enumerate(fit) if m != n)  # noqa: B905
            out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    v[50:90] = v[50]  # ties
    v[200:260] = v[200] + 0.05 * rng.normal(size=(60, 8))
    rows = [(i, v[i].tolist(), 1) for i in range(300)] + [(400, None, 1), (420, [1.0, None, 2.0], 1), (440, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (None, [3.0] * 8, 1), (3, v[3].tolist(), 1), (460, [], 1), (480, [1.0, 2.0], 1)]
    rows += [(20, v[20].tolist(), 1), (20, (-v[20]).tolist(), 1), (7, v[8].tolist(), 1), (7, v[9].tolist(), 1)]  # ids of several rows
    schema = "vec_id long, embedding array<double>, d int"
    told = lambda e, **more: sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(e, F.col("vec_id") % 20 == 0, **more).collect()), key=repr)
    monkeypatch.setattr(topk, "ANNULUS", 8)
    monkeypatch.setattr(topk, "LEAST_BAND", 16)
    monkeypatch.setattr(topk, "SLAB", 5)
    e = topk.quantised(spark.createDataFrame(rows, schema))
    assert told(e, k=5, pivots=4) == brute_topk(rows, 5)
    few = [(20, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.7, 0.0], 1), (None, [0.8, 0.0], 1)]
    assert told(topk.quantised(spark.createDataFrame(few, schema))) == brute_topk(few, 20) and len(brute_topk(few, 20)) == 4
    assert told(topk.quantised(spark.createDataFrame([], schema))) == []


def test_topk_agrees_with_sql(spark, tmp_path):
    import duckdb

    from talkspan.llm import queries

    rng = np.random.default_rng(4)
    rows = [(None if i % 9 == 0 else i % 120, rng.normal(size=6).tolist(), 1) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op4_topk(spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(queries.oracle_sql()["op4_topk"]).fetchall(), key=repr)


def test_topk_stops(spark):
    """In groups that lie far apart a query is held against few vectors but its own group's."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    centre /= np.sqrt((centre * centre).sum(1))[:, None]
    rows = [(i, (10 * centre[i % 20] + 0.05 * rng.normal(size=16)).tolist(), 1) for i in range(8000)]
    e = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, d int"))
    shares = [r.scored / 8000 for r in topk.search(e, F.col("vec_id") % 20 == 0, scored=True).collect()]
    assert len(shares) == 400 and np.mean(shares) < 0.5


# --- 5


def fill(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), list(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(spark):
    d, rows = edge_docs(spark, 80)
    out = mixing.mix(d).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(i), size(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = fill(sizes), defaultdict(int)
    for r in out:
        assert math.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(d.repartition(3)).collect()))
    odd = docs(spark, [(None, f"text {i} " * (i % 7), "a") for i in range(60)] + [(9, f"other {i} " * 3, "a") for i in range(60)])
    parts = {s: (mixing.mix(odd, range_rows=s).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).first()) for s in (1, 4096)}
    assert parts[1] == parts[4096] and abs(parts[1].t - parts[1].x) < 1
    assert mixing.mix(docs(spark, [])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect())


# --- 6


def brute_fingerprint(text, n=4):
    words = [w.decode() for w in plain(text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    d, rows = edge_docs(spark, 40)
    base = text_of(random.Random(9), 400).split()
    more = []
    for i in range(60):
        w = list(base)
        w[(i * 37) % 400] = f"edit{i % 20}"
        more.append((200 + i, " ".join(w), "a"))
    rows = rows + more
    out = simhash.near_duplicates(docs(spark, rows), tile=8).collect()
    assert len(out) == len(rows)
    fp = [brute_fingerprint(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
    comp = union_find(pairs, range(len(rows)))
    least = defaultdict(list)
    for n, c in comp.items():
        if ids[n] is not None:
            least[c].append(ids[n])
    want = sorted((repr(ids[n]), fp[n], repr(min(least[comp[n]], default=None))) for n in range(len(rows)))
    assert sorted((repr(r.doc_id), r.fp % (1 << 64), repr(r.component_id)) for r in out) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_bit_sliced_links():
    rng = np.random.default_rng(0)
    for n, radius in ((2, 4), (40, 4), (49, 3), (300, 4), (300, 7), (128, 0)):
        base = rng.integers(0, 2**63, max(1, n // 6), dtype=np.uint64)
        f = base[rng.integers(0, len(base), n)]
        for _ in range(3):
            f = f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        f = np.unique(f)
        a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
        assert (simhash.forest(len(f), a, b) == simhash.group_links(f, radius)).all()


@pytest.mark.parametrize("radius", [0, 1, 4, 8])
def test_every_close_pair_shares_a_table(radius):
    rng = random.Random(1)
    masks = simhash.tables(radius)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), radius):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


# --- 7


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def library(kind):
    """The library's encoder of the same vocabulary, as BPE or unigram: the last of two values of a field counts."""
    import sentencepiece

    raw = open(pieces.MODEL, "rb").read()

    def varint(x):
        return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)

    out = b""
    for number, value in pieces._fields(raw):
        if number == 2:
            value = bytes(value) + b"\x18" + bytes([kind])
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


SAMPLES = ["", " ", "  a  b\n\n c ", "Hello wörld, it's 3.5!", "日本語テキスト 🎉 x", "\n", "a" * 3000, "tab\there\r\n<s> <0x41>", "x\n y\n\nz ", "ééé ﷽ ​", "the the  the   the"]


def test_pieces_match_the_library(model):
    rng = random.Random(4)
    texts = SAMPLES + ["".join(rng.choice("abcdeinorst ÉéA.,\n") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    bpe = library(pieces.BPE)
    for text, ids, merged in zip(texts, pieces.encode_texts(model, texts)[0], pieces.encode_texts(model, texts, "merge")[0], strict=True):
        assert ids.tolist() == bpe.encode(text) == merged.tolist(), text[:50]
        assert pieces.decode(model, ids.tolist()) == text == bpe.decode(ids.tolist())


def test_viterbi_is_the_best_path(model):
    scores = {p: float(s) for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t == pieces.NORMAL}

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - model.longest), j):
                top[j] = max(top[j], top[i] + scores.get(word[i:j], float(model.unknown_score) if j == i + 1 else -math.inf))
        return top[-1]

    words = ["▁the", "▁hello", "▁époque", "▁xyzzyqq", "▁internationalisation", "日", "▁▁▁a"]
    for word, ids in zip(words, pieces.encode_words(model, words, "viterbi"), strict=True):
        known = [i for i in ids if model.types[i] == pieces.NORMAL]
        if len(known) == len(ids):
            assert "".join(model.pieces[i] for i in ids) == word
            assert math.isclose(sum(float(model.scores[i]) for i in ids), best(word))
    texts = ["Hello wörld the 日本 🎉\n x", "a  b"]
    for text, ids in zip(texts, pieces.encode_texts(model, texts, "viterbi")[0], strict=True):
        assert pieces.decode(model, ids.tolist()) == text


def test_long_words_go_the_same_way(model):
    """Words of any length are cut where no piece crosses and advance together; ids are the library's."""
    rng = random.Random(8)
    bpe = library(pieces.BPE)
    words = ["".join(rng.choice(a) for _ in range(n)) for n in (40, 300, 5000) for a in ("etaoinshr", "ABCdefGHI0123456789+/", "日本語文字列", "aab")] + ["x" * 20_001]
    for word, ids in zip(words, pieces.encode_words(model, ["▁" + w for w in words], "merged_path"), strict=True):
        assert ids == bpe.encode(word)
        assert "".join(pieces.cut(model, word)) == word
    codes = pieces._codes(["▁" + words[0]])
    for scan, batch in ((pieces.scan(model, codes, True), pieces.merged_path(model, codes)), (pieces.scan(model, codes, False), pieces.viterbi(model, codes))):
        assert pieces._walk(model, codes, *scan) == pieces._walk(model, codes, *batch)


def test_held_words_shrink(model, monkeypatch):
    monkeypatch.setattr(pieces, "HELD_WORDS", 40)
    monkeypatch.setattr(pieces, "KEPT", 10)
    rng = random.Random(12)
    bpe, m = library(pieces.BPE), pieces.load()
    for _ in range(6):
        texts = [" ".join(rng.choice(["the", "and", "of"]) + "x" * rng.randrange(20) for _ in range(30)) + ", it's (3.5) a-b." for _ in range(5)]
        assert [x.tolist() for x in pieces.encode_texts(m, texts)[0]] == [bpe.encode(t) for t in texts]
        assert len(m._words["merged_path"].number) < 200


def test_pairs_apart_by_merging(model):
    """The table of merges tells of two pieces what merging their text tells."""
    rng = random.Random(11)
    whole = np.nonzero(model.whole[:-2])[0].tolist()
    alone = pieces.encode_words(model, [model.pieces[i] for i in whole[:3000]], "merge")
    assert alone == [[i] for i in whole[:3000]]
    a, b = (np.array([rng.choice(whole) for _ in range(4000)]) for _ in range(2))
    pairs = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if not model.pieces[y].startswith("▁")]
    want = [ids == [x, y] for ids, (x, y) in zip(pieces.encode_words(model, [model.pieces[x] + model.pieces[y] for x, y in pairs], "merge"), pairs, strict=True)]
    assert model.apart(*(np.array(c) for c in zip(*pairs, strict=True))).tolist() == want and 0 < sum(want) < len(want)


def test_round_trips_are_told(model):
    texts = SAMPLES + ["a▁b", "line\n\nnext  two", "\x01 odd \x02", " x", "x ", "\n", "a\n b"]
    for (ids, same), text in zip(zip(*pieces.encode_texts(model, texts), strict=True), texts, strict=True):
        assert same == (pieces.decode(model, ids.tolist()) == text), text[:30]


def test_pieces_edges(spark, model):
    d, rows = edge_docs(spark)
    out = pieces.encode(d)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    back = pieces.decoded(out.select("doc_id", "ids"))
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == sorted((repr(i), t or "") for i, t, _ in rows)
    assert pieces.encode(docs(spark, [])).count() == 0


# --- 8


def test_licenses(spark):
    name, body = licenses.TEMPLATES[4]
    words = body.split()
    damaged = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    broken = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    filler = text_of(random.Random(2), 700)
    rows = ODD + [(20, filler + " " + body + " " + filler, "a"), (21, damaged, "a"), (22, broken, "a"), (23, "RELEASED under the mit license", "b"), (24, "released under the license", "b"), (25, filler + "\nLicensed under CC BY-NC 4.0.", "b")]
    out = {r.doc_id: [x.license for x in r.found] for r in licenses.scan(docs(spark, rows)).collect()}
    assert out[20] == [name] and out[21] == [name] and out[22] == []
    assert out[23] == ["mit-notice"] and out[24] == [] and out[25] == ["cc-by-nc-4.0-notice"]
    assert all(out[i] == [] for i in (1, 2, 3, 5, 7, None))
    assert licenses.scan(docs(spark, rows)).count() == len(rows)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_templates_find_themselves(spark):
    rows = [(n, "start of text " + b + " end of text", "a") for n, (_, b) in enumerate(licenses.TEMPLATES)]
    out = {r.doc_id: [x.license for x in r.found] for r in licenses.scan(docs(spark, rows)).collect()}
    assert all(name in out[n] for n, (name, _) in enumerate(licenses.TEMPLATES))


def plain_words(text):
    t = regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D.+-]+|[.+-]+(?=[\x20\x09-\x0D]|$)|(?<=[\x20\x09-\x0D]|^)[.+-]+", " ", text.lower())
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def plain_shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_license_containment_by_brute_force(spark):
    """Copies damaged more and less, anywhere in a text: best containment over all windows, and how many are retrieved."""
    rng = random.Random(17)
    rows = []
    for n in range(220):
        _, body = licenses.TEMPLATES[n % len(licenses.TEMPLATES)]
        w = body.split()
        for _ in range(rng.randrange(0, 1 + len(w) // 20)):
            w[rng.randrange(len(w))] = rng.choice(["changed", "words", "here"])
        around = [text_of(rng, rng.randrange(0, 120)) for _ in range(2)]
        rows.append((n, f"{around[0]}\n{' '.join(w)} {around[1]}", "a"))
    got = {r.doc_id: {x.license: (x.containment, x.start) for x in r.found} for r in licenses.scan(docs(spark, rows)).collect()}
    sizes = {n: (1 if n == 1 else 2 ** (math.ceil(math.log2(n)) + 1)) for n in range(1, 400)}
    table = {name: set(plain_shingles(plain_words(body))) for name, body in licenses.TEMPLATES}
    held, found = 0, 0
    for i, t, _ in rows:
        s = plain_shingles(plain_words(t))
        for name, want in table.items():
            size = sizes[len(want)]
            step = max(1, size // 2)
            starts = range(0, max(len(s) - (size - step), 1), step)
            best = max((len(want & set(s[a : a + size])) / len(want), -a - 1) for a in starts)
            if best[0] >= licenses.CONTAINED:
                held += 1
                found += name in got[i]
                assert name not in got[i] or (math.isclose(got[i][name][0], best[0]) and got[i][name][1] == -best[1])
            else:
                assert name not in got[i]
    assert held > 150 and found >= 0.995 * held


# --- 9


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = defaultdict(set)
    rank = lambda i: -1 if i is None else i
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(rank(i))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != rank(i))]
        out.append((repr(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("held", [200_000, 5])
def test_lines(spark, monkeypatch, held):
    monkeypatch.setattr(linededup, "HELD", held)
    rng = random.Random(6)
    pool = [f"  Shared line number {i} of the Pool \t" for i in range(12)] + ["short", "", "ÉCOLE maternelle supérieure", "exactly twenty chars"]
    rows = ODD + [(100 + i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 12))) + f"\nown line of document {i}", "a") for i in range(60)]
    rows += [(None, "  Shared line number 3 of the Pool", "b")]
    rows += [(None, f"one of many rows without an id {i}\n{pool[i % 3]}", "b") for i in range(40)] + [(120, f"a row {i} of one id\n{pool[4]}\n{pool[5]}", "b") for i in range(30)]
    rows += [(None, "a line that only rows without an id have " + "\n" + str(i), "b") for i in range(20)] + [(150, "another text with the same id here\n" + pool[2], "b"), rows[-1]]
    d = docs(spark, rows)
    marks = linededup.keep_bitmaps(d)
    out = linededup.kept_digests(d, marks).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == brute_lines(rows)
    texts = linededup.apply_bitmaps(d, marks).collect()
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in texts) == sorted(x[3] for x in brute_lines(rows))
    none = docs(spark, [])
    assert linededup.kept_digests(none, linededup.keep_bitmaps(none)).count() == 0


# --- 10


def brute_links(rows, threshold=0.98):
    fit = lambda v, lab: lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    pairs = []
    for a, (_, v, x) in enumerate(rows):
        for b, (_, w, y) in enumerate(rows[:a]):
            if fit(v, x) and fit(w, y) and x == y and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / math.sqrt((p @ p) * (q @ q)) >= threshold:
                    pairs.append((a, b))
    return pairs


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for label in (0, 1, None):
        for c in range(30):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 12)):
                rows.append((n, (centre + 0.04 * rng.normal(size=16)).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [1.0, 2.0], 0), (905, [1e300] * 16, 1), (906, [1e-300] * 16, 1)]
    rows.append(rows[5])
    out = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=40).collect()
    assert len(out) == len(rows)
    pairs = brute_links(rows)
    ids = [r[0] for r in rows]
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    comp = union_find(pairs, range(len(rows)))
    least = defaultdict(list)
    for i, c in comp.items():
        least[c].append(ids[i])
    want = sorted((ids[i], links[i], min(least[comp[i]]), ids[i] == min(least[comp[i]])) for i in range(len(rows)))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.mark.parametrize("dense", [0, 900])
def test_graph_recall(dense):
    """Links of pairs are found beside a dense group too: recall is the mean over classes that have links."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + 0.03 * rng.normal(size=(1500, 32))
    if dense:
        x[:dense] = x[0] + 0.02 * rng.normal(size=(dense, 32))
    x = x[rng.permutation(3000)]
    g, links, _, recall, turned = hnsw.shard_graph(x, np.ones(3000, np.int64), 0.98)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    truth = (unit @ unit.T >= 0.98).sum(1) - 1
    assert (links.found <= truth).all() and (links.linked == links.found).all()
    assert min(recall, turned) >= hnsw.RECALL
    some = truth > 0
    assert (links.found[some] / truth[some]).mean() >= 0.98
    r, i = hnsw.range_search(g, g.x[:500], 24, 0.98)
    assert len(set(zip(r.tolist(), i.tolist(), strict=True))) == len(r) and len(r) >= 0.97 * (truth[:500] + 1).sum()


def test_pockets_of_a_dense_group():
    """Tight pockets within a dense group, whose nearest members are all of their own pocket: no link is lost."""
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    x = unit(rng.normal(size=(900, 64)))
    centres = unit(unit(rng.normal(size=64)) + 0.1 * unit(rng.normal(size=(4, 64))))
    pockets = unit(centres[:, None, :] + 0.001 * unit(rng.normal(size=(4, 60, 64)))).reshape(-1, 64)
    v = np.concatenate((x, pockets))
    v = v[rng.permutation(len(v))]
    links = hnsw.Links(v, np.ones(len(v), np.int64), 0.98)
    hnsw.build(v, hnsw.BEAM, 0.98 - hnsw.SLACK, links.met, lambda: links.label)
    assert links.linked.sum() == (v @ v.T >= 0.98).sum() - len(v)


def test_a_wide_beam_takes_bounded_memory():
    x = np.random.default_rng(0).normal(size=(700, 64))
    tracemalloc.start()
    try:
        hnsw.build(x, 500, 0.98)
        assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()


def test_every_length_of_token_has_decoys(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefABCDEF0123456789xyzXYZ", k=n)) for n in range(16, 36)) + " " + text_of(rng, 300)
    rows = docs(spark, [(1, text, "a")])
    found = secrets.find_all(F.col("text"), f"({secrets.BEGIN}{secrets.TOKEN}+)", secrets.BEGIN, secrets.MIN_TOKEN)
    (r,) = rows.withColumn("found", found).select(secrets._decoys(F.col("text"), F.col("found")).alias("d"), "found").collect()
    lengths = {s.end - s.start for s in r.found}
    assert len(lengths) > 8 and {len(d) for d in r.d} == lengths and len(r.d) == secrets.STYLES * len(lengths)


def test_the_scans_last_plan_holds_no_battery(spark):
    """The driver's memory grows with its plans: what the battery gives is stored, not planned again at each use."""
    rng = random.Random(6)
    token = lambda: "".join(rng.choices("abcdefABCDEF0123456789xyzXYZ", k=24))
    out = secrets.scan(docs(spark, [(i, f"{text_of(rng, 20)} {token()} {text_of(rng, 20)}", "a") for i in range(40)]))
    plan = out._jdf.queryExecution().toString()
    assert "instr(" not in plan and len(plan) < 100_000
    assert out.count() == 40


def test_recall_audits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8)).tolist(), 1) for i in range(400)]
    rows += [(500 + i, (np.array(rows[i][1]) + 0.01 * rng.normal(size=8)).tolist(), 1) for i in range(100)]
    audits = hnsw.recall_audits(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=100).collect()
    assert len(audits) == 5 + 10 and all(r.recall >= hnsw.RECALL for r in audits)


def test_forms_of_columns(spark):
    """Ids of another integer type are taken as they are."""
    d = docs(spark, [(1, "a b c", "s"), (2, "a b c", "s")]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert {r.component_id for r in simhash.near_duplicates(d).collect()} == {1}
