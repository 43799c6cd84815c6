"""Operators against sequential restatements, known values and invariants."""

from __future__ import annotations

import io
import itertools
import json
import math
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkspan.functions import arrays, mathx, text, udfs
from talkspan.operators import catalog, edits, joins, merge, scoring, segment, sequences, signal, tokens, vectors
from talkspan.plans import recordings
from talkspan.settings import Settings
from talkspan.sources import audio, files
from talkspan.streaming import frames as streams


def turns(spark, rows):
    return spark.createDataFrame([(1, i, s, e, sp) for i, (s, e, sp) in enumerate(rows)], "item_id long, turn_no long, start_ms long, end_ms long, speaker int")


def some_turns(seed, n=60):
    rng = random.Random(seed)
    out, t = [], 0
    for _ in range(n):
        t += rng.randint(0, 900)
        out.append((t, t + rng.randint(50, 3000), rng.randrange(3)))
    return out


def walk(rows, gap, strict=False, sort=True):
    out = []
    for s, e, sp in sorted(rows, key=lambda r: (r[0], r[2])) if sort else rows:
        if out and out[-1][2] == sp and (gap is None or (s - out[-1][1] < gap if strict else s - out[-1][1] <= gap)):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, sp])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap,sort,strict", [(300, True, False), (0, False, False), (4000, False, False), (None, False, False), (300, True, True)])
def test_gap_merge(spark, gap, sort, strict):
    for seed in range(3):
        rows = some_turns(seed)
        got = merge.gap_merge(turns(spark, rows), ["item_id"], gap, sort=sort, strict=strict).collect()
        assert sorted((r.start_ms, r.end_ms, r.speaker) for r in got) == walk(rows, gap, strict, sort)
        assert sum(r.n for r in got) == len(rows)
    again = merge.gap_merge(turns(spark, walk(rows, 300)), ["item_id"], 300).collect()
    assert sorted((r.start_ms, r.end_ms, r.speaker) for r in again) == walk(rows, 300)
    assert merge.gap_merge(turns(spark, []), ["item_id"], 300).count() == 0


def test_fragment_zones(spark):
    rows = [(0, 100, 0), (200, 300, 1), (400, 560, 1), (1000, 3000, 0), (3100, 3200, 1), (3300, 3400, 0), (4000, 9000, 2)]
    got = merge.fragment_zones(turns(spark, rows), ["item_id"]).collect()
    assert sorted((r.start_ms, r.end_ms, r.speaker) for r in got) == [(0, 560, 1), (1000, 3000, 0), (3100, 3200, 1), (3300, 3400, 0), (4000, 9000, 2)]


def vad(p, thr, sil, sp, pad, near, frame=512):
    out, start, low = [], None, 0
    for i, x in enumerate(p):
        if x >= thr:
            start, low = (i if start is None else start), 0
        elif start is not None:
            low += 1
            if low >= sil:
                out.append((start, i - low + 1))
                start, low = None, 0
    if start is not None:
        out.append((start, len(p)))
    out = [(max(0, a * frame - pad), min(len(p) * frame, b * frame + pad)) for a, b in out if b - a >= sp]
    merged = []
    for a, b in out:
        if merged and a - merged[-1][1] < near:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def test_hysteresis(spark):
    rng = random.Random(1)
    for n in (1, 20, 400):
        p, x = [], 0.1
        for _ in range(n):
            x = min(1.0, max(0.0, x + rng.uniform(-0.25, 0.25)))
            p.append(x)
        f = spark.createDataFrame([(1, i, v) for i, v in enumerate(p)], "item_id long, frame_no long, prob double")
        got = sorted((r.start, r.end) for r in segment.hysteresis(f, "item_id", 0.5, pad_ms=40, merge_ms=100).collect())
        assert got == vad(p, 0.5, 3, 7, 640, 1600)


def test_attribution_edges(spark):
    w = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 500, 600), (1, 2, 5000, 5000), (2, 0, 10, 20), (1, 3, None, 0), (1, 4, 900, 700)], "c long, pos long, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 0, 0, 400, 2), (1, 1, 650, 1000, -3), (1, 2, 650, 1000, 1)], "c long, turn long, start_ms long, end_ms long, speaker int")
    got = {(r.c, r.pos): (r.speaker, r.how) for r in joins.attribute_words(w, t, "c").collect()}
    assert got[(1, 0)] == (2, "overlap") and got[(2, 0)] == (0, "none")
    assert got[(1, 1)] == (0, "near")  # 100 after the one, 100 before the other's middle: the next is nearer by centre
    assert got[(1, 2)] == (0, "near") and got[(1, 4)] == (0, "overlap")
    assert len(got) == 6



def test_sequential_groups(spark):
    rng = random.Random(3)
    words = [(1, i, rng.choice(["a", "b.", "c", "d", "e"]), i * 100, i * 100 + 90, (i // 37) % 2) for i in range(300)]
    df = spark.createDataFrame(words, "conv_id long, pos long, tok string, start_ms long, end_ms long, speaker int")
    groups = []
    for _, _, tok, *_, sp in words:
        if not groups or groups[-1][1] != sp or len(groups[-1][0]) >= 34 or (len(groups[-1][0]) >= 10 and groups[-1][0][-1][-1] in ".?!:"):
            groups.append(([], sp))
        groups[-1][0].append(tok)
    got = [r.text for r in segment.sentence_groups(df, "conv_id").orderBy("seg_no").collect()]
    assert got == [" ".join(g) for g, _ in groups]


def test_chunkers(spark):
    one = spark.range(1)
    lengths = lambda n: [(r.start, r.end) for r in segment.token_chunks(one, ["id"], F.lit(n).cast("long")).orderBy("chunk").collect()]
    assert lengths(0) == [] and lengths(56) == [(0, 56)] and lengths(57) == [(0, 37), (21, 57)] and lengths(96) == [(0, 56), (40, 96)] and lengths(97) == [(0, 56), (40, 96), (80, 97)]
    s = spark.createDataFrame([(1, 0, 1_000_000), (2, 5, 6), (3, 7, 7)], "k long, start long, end long")
    got = [(r.k, r.start, r.end) for r in segment.overlapped_chunks(s, ["k"], 480_000, 48_000).orderBy("k", "chunk").collect()]
    assert got == [(1, 0, 480_000), (1, 432_000, 960_000), (1, 912_000, 1_000_000), (2, 5, 6)]
    win = [(r.start, r.end) for r in segment.sliding_windows(one, ["id"], F.lit(290).cast("long")).orderBy("win").collect()]
    assert win == [(0, 150), (60, 210), (120, 270), (140, 290)]


def test_natural_and_blips():
    assert sequences.natural([(0, 100, 0), (10, 20, 1)], None) == [(0, 100, 0), (10, 20, 1)]
    rows = [(0, 3000, 0), (3100, 3500, 1), (3600, 9000, 0), (9100, 20000, 1)]
    assert sequences.natural(rows, None)[1] == (3100, 3500, 0)
    assert sequences.natural(rows, [3200, 3250, 3300, 3350])[1] == (3100, 3500, 1)
    long = [(0, 10000, 0), (1000, 2400, 1), (2600, 4000, 1)]  # a stretch of three seconds, though its turns are short
    assert sequences.natural(long, None) == long
    brief = [(0, 10000, 0), (1000, 1400, 1), (1600, 2400, 1)]
    assert [t[2] for t in sequences.natural(brief, None)] == [0, 0, 0]
    assert [t[2] for t in sequences.natural(brief, [1100, 1200, 1700, 1800])] == [0, 1, 1]  # four words in all
    assert sequences.drop_blips([(0, 1000, 0), (1000, 1500, 1), (1500, 3000, 0), (3000, 3100, 1)]) == [(0, 1500, 0), (1500, 3000, 0)]


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 60), st.integers(0, 3)), min_size=3, max_size=25))
@settings(max_examples=200, deadline=None)
def test_natural_by_the_rules(raw):
    """Step by step: stretches, who holds whom, and which held ones move."""
    turns = sorted({(s * 100, (s + n) * 100, sp) for s, n, sp in raw}, key=lambda t: (t[0], t[2], t[1]))
    stretch, open_ = {}, {}
    spans = []
    for i, (s, e, sp) in enumerate(turns):
        k = open_.get(sp)
        if k is None or s - spans[k][1] >= 2000:
            k = open_[sp] = len(spans)
            spans.append([s, e, sp])
        spans[k][1] = max(spans[k][1], e)
        stretch[i] = k
    seen = list(dict.fromkeys(t[2] for t in turns))
    order = sorted(range(len(spans)), key=lambda k: (spans[k][0], seen.index(spans[k][2])))
    holder = {}
    for n, k in enumerate(order):
        for j in order[n + 1 :] if k not in holder else []:
            if spans[j][0] < spans[k][1] and spans[j][1] <= spans[k][1] and spans[j][2] != spans[k][2]:
                holder.setdefault(j, spans[k][2])
    want = []
    for i, (s, e, sp) in enumerate(turns):
        k = stretch[i]
        want.append((s, e, holder[k] if k in holder and spans[k][1] - spans[k][0] < 2000 else sp))
    if len(turns) > 2:
        assert sequences.natural(turns, None) == want


@given(st.lists(st.text("abcdefgh", min_size=3, max_size=8), min_size=30, max_size=120, unique=True), st.integers(4000, 9000))
@settings(max_examples=25, deadline=None)
def test_stitching_restores_the_text(words, size):
    step = size - 2000
    timed = [(w, i * 200, i * 200 + 150, 0.5) for i, w in enumerate(words)]
    chunks = [{"start_ms": c, "end_ms": c + size, "words": [w for w in timed if c <= w[1] < c + size]} for c in range(0, len(words) * 200, step)]
    out = [w[0] for w in sequences.stitch(chunks)]
    assert len(set(out)) >= 0.9 * len(words)


def test_stitching_prefers_the_surer_words():
    a = {"start_ms": 0, "end_ms": 1000, "words": [("one", 0, 90, 0.9), ("two", 700, 790, 0.9), ("tree", 800, 890, 0.2)]}
    b = {"start_ms": 600, "end_ms": 1600, "words": [("two", 700, 790, 0.9), ("xyzzy", 800, 890, 0.8), ("four", 1100, 1190, 0.9)]}
    assert [w[0] for w in sequences.stitch([a, b])] == ["one", "two", "xyzzy", "four"]
    assert sequences.stitch([]) == []


@given(st.lists(st.sampled_from("alpha beta gama gamma delta be ét Ét! eps 42 ...".split()), min_size=0, max_size=9), st.lists(st.sampled_from("alpha beta gamma Gamma, delta be et ét eps 4 2".split()), min_size=0, max_size=9), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_seams_by_the_rules(left, right, seed):
    """Every offset and every word, one at a time."""
    rng = random.Random(seed)
    tail, head = ([(w, i, i, rng.choice([0.25, 0.5, 0.875])) for i, w in enumerate(ws)] for ws in (left, right))
    plain = lambda w: "".join(c for c in w.lower() if c.isalpha() or c.isdecimal() or c == "_")

    def edits(x, y):
        return max(len(x), len(y)) if not x or not y else min(edits(x[1:], y) + 1, edits(x, y[1:]) + 1, edits(x[1:], y[1:]) + (x[0] != y[0]))

    def same(x, y):
        if x == y or not x or not y:
            return x == y
        return len(x) > 2 and len(y) > 2 and (x in y or y in x) or 1 - edits(x, y) / max(len(x), len(y)) >= 0.8

    best, drop, skip = 0, len(tail), 0
    for off in range(-len(tail) + 1, len(head)):
        pairs = [(i, i + off) for i in range(len(tail)) if 0 <= i + off < len(head)]
        hits = [(i, j) for i, j in pairs if same(plain(left[i]), plain(right[j]))]
        if len(hits) > best and len(hits) / len(pairs) >= 0.5:
            best, drop, skip = len(hits), len(tail) - 1 - hits[-1][0], hits[-1][1] + 1
    if not tail or not head:
        want = (0, 0)
    elif best == 0 or (best < min(len(tail), len(head)) and drop > 0):
        mean = lambda ws: np.mean([w[3] for w in ws]) if ws else 1.0
        want = (0, len(head)) if mean(tail[len(tail) - drop :]) > mean(head[skip:]) else (len(tail), 0)
    else:
        want = (drop, skip)
    assert sequences.seam(tail, head) == want


def test_stitching_by_parts():
    w = lambda text, at, p=0.5: (text, at, at + 90, p)
    a = {"start_ms": 0, "end_ms": 5000, "words": [w("one", 100), w("two", 1900), w("three", 2500), w("four", 4000)]}
    b = {"start_ms": 1000, "end_ms": 6000, "words": [w("three", 2500), w("four", 3990), w("five", 5500)]}
    assert [x[0] for x in sequences.stitch([a, b])] == ["one", "two", "three", "four", "five"]  # three seconds count, not four
    assert [x[0] for x in sequences.stitch([a, {"start_ms": 4960, "end_ms": 9000, "words": [w("four", 4970)]}])][-2:] == ["four", "four"]  # too short an overlap
    assert sequences.stitch([a, {"start_ms": 3000, "end_ms": 9000, "words": []}]) == a["words"]
    assert [x[0] for x in sequences.stitch([{"start_ms": 0, "end_ms": 3000, "words": []}, b])] == ["three", "four", "five"]
    surer = {"start_ms": 2000, "end_ms": 7000, "words": [w("other", 2100, 0.9), w("words", 4000, 0.9), w("end", 6000, 0.9)]}
    assert [x[0] for x in sequences.stitch([a, surer])] == ["one", "two", "other", "words", "end"]
    less = surer | {"words": [(t, s, e, 0.1) for t, s, e, _ in surer["words"]]}
    assert [x[0] for x in sequences.stitch([a, less])] == ["one", "two", "three", "four", "end"]


def test_joining_lists():
    parts = [list(map(str, range(0, 56))), list(map(str, range(40, 96))), list(map(str, range(80, 100)))]
    assert sequences.join_lists(parts) == list(map(str, range(100)))
    words = lambda a, n: [f"{a}{i}" for i in range(n)]
    assert len(sequences.join_lists([words("a", 40), words("b", 40)])) == 70  # nothing shared: ten of the right go
    assert sequences.join_lists([words("a", 7), words("b", 8)]) == words("a", 7) + ["b7"]
    seam = ["x", *words("S", 7)]
    assert sequences.join_lists([seam, [w.lower() for w in words("S", 7)] + ["y"]]) == ["x", *words("S", 6), "s6", "y"]  # cases differ
    assert sequences.join_lists([words("a", 6) + ["."], ["a0", ",", *words("a", 6)[1:], "z"]]) == ["a0", "a1", "a2", "a3", "a4", "a5", "z"]  # marks do not count
    assert sequences.join_lists([words("a", 3), [".", ","]]) == [*words("a", 3), ".", ","]
    assert sequences.join_lists([]) == [] and sequences.join_lists([[], ["a"]]) == ["a"]


def test_edits():
    e = [(0, "case", "CAPITAL"), (0, "append", ","), (1, "append", "."), (2, "case", "UPPER_-1"), (9, "append", ".")]
    assert sequences.apply_edits(["one", "two", "three"], e) == ["One", ",", "two", ".", "THREe"]
    assert sequences.apply_edits(["a", ","], [(0, "append", ",")]) == ["a", ","]
    flip = lambda t, n: [(0, "case", "UPPER" if t[0].islower() else "LOWER")]
    assert sequences.refine(["x"], flip) == ["x"]


def test_clustering():
    rng = np.random.default_rng(0)
    base = np.linalg.qr(rng.normal(size=(32, 32)))[0][:4]
    label = rng.integers(0, 4, 60)
    x = vectors.unit(base[label] + 0.05 * rng.normal(size=(60, 32)))
    want = vectors.first_seen_labels(label)
    for got in (vectors.spectral(x), vectors.kmeans(x, 4), vectors.agglomerate(x, 0.9)):
        assert (vectors.first_seen_labels(got) == want).all()
    merged = vectors.merge_close(x, np.arange(60) % 2 + 2 * label)
    assert len(np.unique(merged)) == 4
    gamma, pi = vectors.vbx(x * 4, np.linspace(2, 0.2, 32), want)
    assert np.allclose(gamma.sum(1), 1) and math.isclose(pi.sum(), 1)
    assert vectors.spectral(x[:5]).tolist() == [0] * 5
    assert vectors.assign(np.array([[1.0, 5.0], [4.0, 4.5], [0.0, 0.0]])).tolist() == [1, 0, -1]
    assert vectors.assign(np.array([[0.1, 0.9, 0.5]])).tolist() == [1]


def plain_chunk_labels(x, alone, active, p):
    """The clustering of local speakers, step by step in plain Python."""
    dot = lambda a, b: sum(i * j for i, j in zip(a, b, strict=True))
    unit = lambda a: [i / math.sqrt(max(dot(a, a), 1e-20)) for i in a]
    good = lambda a: all(map(math.isfinite, a))
    train = [v for vs, al in zip(x, alone, strict=True) for v, w in zip(vs, al, strict=True) if w >= 0.2 and good(v)]
    if len(train) < 2:
        return [[s if on else -2 for s, on in enumerate(row)] for row in active]
    groups = [(unit(v), [i]) for i, v in enumerate(train)]
    label = list(range(len(train)))
    while len(groups) > 1:
        far, a, b = min((math.dist(groups[a][0], groups[b][0]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        (ca, ma), (cb, mb) = groups[a], groups[b]
        if far <= 0.6:
            joined = {label[i] for i in ma + mb}
            label = [min(joined) if n in joined else n for n in label]
        middle = [(i * len(ma) + j * len(mb)) / (len(ma) + len(mb)) for i, j in zip(ca, cb, strict=True)]
        groups = [g for n, g in enumerate(groups) if n not in (a, b)] + [(middle, ma + mb)]
    seen = list(dict.fromkeys(label))
    label = [seen.index(n) for n in label]
    y = []
    for v in train:
        u = [math.sqrt(len(v)) * i for i in unit([i - m for i, m in zip(v, p.mean1, strict=True)])]
        u = [dot(u, p.lda[:, j]) - p.mean2[j] for j in range(p.lda.shape[1])]
        u = [math.sqrt(len(u)) * i - m for i, m in zip(unit(u), p.mu, strict=True)]
        y.append([dot(u, row) for row in p.basis])
    k, dim, fa, fb = len(seen), len(y[0]), 0.07, 0.8
    gamma = [[math.exp(7.0 * (c == n)) / (k - 1 + math.exp(7.0)) for c in range(k)] for n in label]
    pi, before = [1 / k] * k, -math.inf
    for _ in range(20):
        inv = [[1 / (1 + fa / fb * sum(g[c] for g in gamma) * p.phi[d]) for d in range(dim)] for c in range(k)]
        alpha = [[fa / fb * inv[c][d] * sum(g[c] * v[d] * math.sqrt(p.phi[d]) for g, v in zip(gamma, y, strict=True)) for d in range(dim)] for c in range(k)]
        total, bound = [], 0.0
        for v in y:
            ll = [fa * (sum(v[d] * math.sqrt(p.phi[d]) * alpha[c][d] - 0.5 * p.phi[d] * (inv[c][d] + alpha[c][d] ** 2) for d in range(dim)) - 0.5 * (dot(v, v) + dim * math.log(2 * math.pi))) + math.log(pi[c] + 1e-8) for c in range(k)]
            top = max(ll)
            all_ = top + math.log(sum(math.exp(i - top) for i in ll))
            bound += all_
            total.append([math.exp(i - all_) for i in ll])
        gamma = total
        pi = [sum(g[c] for g in gamma) / len(gamma) for c in range(k)]
        bound += fb * 0.5 * sum(math.log(inv[c][d]) - inv[c][d] - alpha[c][d] ** 2 + 1 for c in range(k) for d in range(dim))
        if bound - before < 1e-4:
            break
        before = bound
    live = [c for c in range(k) if pi[c] > 1e-7] or [0]
    centre = [[sum(g[c] * v[d] for g, v in zip(gamma, train, strict=True)) / max(1e-8, sum(g[c] for g in gamma)) for d in range(len(train[0]))] for c in live]
    out = []
    for vs, on in zip(x, active, strict=True):
        like = [[1 + dot(v, c) / (math.sqrt(dot(v, v)) * math.sqrt(dot(c, c)) + 1e-10) if good(v) else 1.0 for c in centre] for v in vs]
        low = min(map(min, like)) - 1
        like = [row if o and good(v) else [low] * len(centre) for row, o, v in zip(like, on, vs, strict=True)]
        options = [c for c in itertools.product([*range(len(centre)), None], repeat=3) if len(taken := [i for i in c if i is not None]) == len(set(taken)) == min(3, len(centre))]
        best = max(options, key=lambda c: sum(like[s][i] for s, i in enumerate(c) if i is not None))
        out.append([-2 if not o or c is None else c for c, o in zip(best, on, strict=True)])
    return out


@pytest.mark.parametrize(("voices", "seed"), [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)])
def test_chunk_labels_by_the_rules(voices, seed):
    rng = np.random.default_rng(seed)
    p = recordings.projection(12, 8)
    base = np.linalg.qr(rng.normal(size=(12, 12)))[0][:voices]
    who = np.array([rng.permutation(np.arange(max(3, voices)))[:3] for _ in range(8)])
    x = base[who % voices] + 0.08 * rng.normal(size=(8, 3, 12))
    x[1, 2], x[4, 0, 3] = np.nan, np.inf
    alone, active = rng.random((8, 3)), rng.random((8, 3)) < 0.85
    got = vectors.chunk_labels(x, alone, active, p)
    assert got.tolist() == plain_chunk_labels(x.tolist(), alone.tolist(), active.tolist(), p)
    few = vectors.chunk_labels(x, np.zeros((8, 3)), active, p)
    assert few.tolist() == plain_chunk_labels(x.tolist(), np.zeros((8, 3)).tolist(), active.tolist(), p)


def test_chunk_speakers(spark):
    """Missing speakers and vectors; rows of an item in any order."""
    p = recordings.projection()
    v = np.linalg.qr(np.random.default_rng(0).normal(size=(64, 64)))[0]
    rows = [(1, c, s, (v[s] + 0.01 * c).tolist(), 0.5, True) for c in range(6) for s in range(3) if (c, s) != (2, 1)] + [(2, 0, 0, None, 0.9, True), (2, 3, 2, v[0].tolist(), 0.9, False)]
    random.Random(0).shuffle(rows)
    d = spark.createDataFrame(rows, "item_id long, chunk long, speaker int, vector array<double>, alone double, active boolean")
    got = {(r.item_id, r.chunk, r.speaker): r.label for r in vectors.chunk_speakers(d, "item_id", p).collect()}
    assert len(got) == len(rows) and got[2, 0, 0] == 0 and got[2, 3, 2] == -2
    assert all(len({got[1, c, s] for c in range(6) if (c, s) != (2, 1)}) == 1 for s in range(3)) and len({got[1, 0, s] for s in range(3)}) == 3
    assert vectors.chunk_speakers(d.limit(0), "item_id", p).count() == 0


def test_feature_options():
    o = signal.FbankOptions()
    assert o.frame_opts.length == 400 and o.frame_opts.shift == 160 and o.frame_opts.padded == 512
    o.mel_opts.num_bins = 80
    assert signal.FbankOptions.from_dict(o.as_dict()) == o
    assert signal.MfccOptions.from_dict(signal.MfccOptions().as_dict()).num_ceps == 13
    with pytest.raises(ValueError):
        signal.FbankOptions.from_dict({"nonsense": 1})
    with pytest.raises(ValueError):
        signal.window("nonsense", 4)
    with pytest.raises(ValueError):
        signal.mfcc(np.zeros(400), signal.MfccOptions(num_ceps=99))


@pytest.mark.parametrize("n", [4, 6, 8, 10, 16, 32, 64, 128, 512, 1000, 1024])
def test_packed_fft(n):
    x = np.random.default_rng(n).random(n)
    p, s = signal.packed_rfft(x), np.fft.rfft(x)
    assert np.allclose(p[2::2] + 1j * p[3::2], s[1:-1]) and np.allclose(p[:2], [s[0].real, s[-1].real])
    assert np.allclose(signal.unpacked_irfft(p) / n, x)
    with pytest.raises(ValueError):
        signal.packed_rfft(np.zeros(5))


def plain_spectrum(f):
    """|DFT|^2 of the first half and the middle, by its definition."""
    n = len(f)
    return [abs(sum(x * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i, x in enumerate(f))) ** 2 for k in range(n // 2 + 1)]


def plain_frame(x, first, length, padded, shape):
    """A frame as the options ask for by default: no offset, pre-emphasis of 0.97, a window, zeros behind."""
    f = [x[i if 0 <= i < len(x) else (-i - 1 if i < 0 else 2 * len(x) - 1 - i)] for i in range(first, first + length)]
    f = [v - sum(f) / length for v in f]
    energy = math.log(sum(v * v for v in f))
    f = [v - 0.97 * f[max(0, i - 1)] for i, v in enumerate(f)]
    return [v * shape(2 * math.pi * i / (length - 1)) for i, v in enumerate(f)] + [0.0] * (padded - length), energy


@pytest.mark.parametrize("snip", [True, False])
def test_fbank_and_mfcc_by_definition(snip):
    x = np.random.default_rng(3).normal(size=900).tolist()
    o = signal.FrameOptions(samp_freq=8000.0, frame_length_ms=16.0, snip_edges=snip)  # 128 samples every 80
    mel = lambda hz: 1127 * math.log(1 + hz / 700)
    bins, rate = 7, 8000
    edges = [mel(20) + (mel(4000) - mel(20)) * i / (bins + 1) for i in range(bins + 2)]
    firsts = range(0, 900 - 127, 80) if snip else [80 * i + 40 - 64 for i in range((900 + 40) // 80)]
    mels, ceps = [], []
    for first in firsts:
        f, energy = plain_frame(x, first, 128, 128, lambda a: (0.5 - 0.5 * math.cos(a)) ** 0.85)
        power, row = plain_spectrum(f), []
        for left, centre, right in zip(edges, edges[1:], edges[2:]):
            total = 0.0
            for k in range(64):
                m = mel(k * rate / 128)
                if left < m < right:
                    total += power[k] * ((m - left) / (centre - left) if m <= centre else (right - m) / (right - centre))
            row.append(math.log(max(total, float(np.finfo(np.float32).eps))))
        mels.append(row)
        dct = [math.sqrt((1 if k == 0 else 2) / bins) * sum(v * math.cos(math.pi / bins * (j + 0.5) * k) for j, v in enumerate(row)) for k in range(5)]
        ceps.append([energy] + [v * (1 + 11 * math.sin(math.pi * k / 22)) for k, v in enumerate(dct)][1:])
    mo = signal.MelOptions(num_bins=bins)
    assert np.allclose(signal.fbank(np.array(x), signal.FbankOptions(frame_opts=o, mel_opts=mo)), mels, atol=1e-8)
    assert np.allclose(signal.mfcc(np.array(x), signal.MfccOptions(frame_opts=o, mel_opts=mo, num_ceps=5)), ceps, atol=1e-8)


@pytest.mark.parametrize("slaney", [True, False])
@pytest.mark.parametrize("floor", [True, False])
@pytest.mark.parametrize("norm", ["slaney", ""])
def test_triangles_over_frequency(slaney, floor, norm):
    up = lambda f: (f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)) if slaney else 1127 * math.log(1 + f / 700)
    down = lambda m: (m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)) if slaney else 700 * (math.exp(m / 1127) - 1)
    corners = [down(up(30) + (up(8000) - up(30)) * i / 41) for i in range(42)]
    corners = [int(c * 513 / 16000) for c in corners] if floor else corners
    got = signal.slaney_bank(signal.MelOptions(num_bins=40, low_freq=30.0, is_librosa=True, norm=norm, use_slaney_mel_scale=slaney, floor_to_int_bin=floor), 16000.0, 512)
    for b, (lo, mid, hi) in enumerate(zip(corners, corners[1:], corners[2:])):
        for k in range(257):
            at = k if floor else k * 16000 / 512
            want = ((at - lo) / (mid - lo) if at <= mid else (hi - at) / (hi - mid)) if lo < at < hi else 0
            assert math.isclose(got[b, k], want * (2 / (hi - lo) if norm and want else 1), abs_tol=1e-9), (b, k)


@pytest.mark.parametrize("n_fft", [64, 256, 400, 512])
@pytest.mark.parametrize("normalized", [False, True])
@pytest.mark.parametrize("kind", ["hann", "hanning", "povey", ""])
def test_stft_returns(n_fft, normalized, kind):
    x = np.random.default_rng(1).random(20_000)
    o = signal.StftOptions(n_fft=n_fft, hop_length=n_fft // 4, win_length=n_fft, window_type=kind, normalized=normalized)
    y = signal.istft(signal.stft(x, o), o)
    assert np.abs(y - x[: len(y)]).max() < 1e-6 or kind in ("hanning", "povey") and np.abs(y - x[: len(y)])[1:-1].max() < 1e-6


def test_frames_and_features():
    x = np.arange(10_000.0)
    assert (signal.raw_frames(x, 30, 30)[7] == np.arange(210, 240)).all()
    x = signal.diagnostic_signal()
    assert len(x) == 48_123
    f = signal.fbank(x, signal.FbankOptions(mel_opts=signal.MelOptions(num_bins=80)))
    assert f.shape == (1 + (48_123 - 400) // 160, 80) and np.isfinite(f).all()
    bank = signal.mel_bank(signal.MelOptions(num_bins=80), 16_000, 512)
    hz = np.array([233, 701, 1234.5])
    top = [int(np.argmax(bank[:, round(h / 16_000 * 512)])) for h in hz]
    mean = f.mean(0)
    assert all(mean[t] > mean[t + 6] for t in top)
    assert signal.whisper_mel(x).shape[1] == 80 and signal.mfcc(x, signal.MfccOptions()).shape[1] == 13
    o = signal.FrameOptions(snip_edges=False)
    assert len(signal.framed(x, o)) == (48_123 + 80) // 160
    for name in ("recognition", "campp", "wespeaker"):
        m = signal.preset_features(x, name)
        assert m.shape[1] == 80 and (name == "recognition" or np.allclose(m.mean(0), 0, atol=1e-6))
    assert len(signal.resample(np.ones(8000), 8000)) == 16_000
    basis, psi = signal.plda_basis(np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))[0] * 2, np.arange(1.0, 7.0))
    assert (np.diff(psi) <= 1e-12).all() and basis.shape == (6, 6)
    y = signal.xvector(np.random.default_rng(2).normal(size=(5, 8)), np.zeros(8), np.eye(8)[:, :4], np.zeros(4))
    assert np.allclose((y * y).sum(1), 4)


def test_columns_agree_with_kernels(spark):
    for kind in ("hanning", "hamming", "hann", "povey", "blackman", "sine", "rectangular"):
        w = spark.range(1).select(arrays.window_function(kind, 25).alias("w")).first().w
        assert np.allclose(w, signal.window(kind, 25))
    r = spark.range(1).select(
        arrays.l2(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), arrays.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0))).alias("d"), arrays.argsort(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0))).alias("s"),
        arrays.padded(F.array(F.lit(1.0)), 3).alias("p"), arrays.gather(F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0))), F.array(F.struct(F.lit(-1).alias("start"), F.lit(1).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(9).alias("end")))).alias("g"),
        mathx.finite_or(F.lit(float("nan")), F.lit(7.0)).alias("f"), mathx.hz_slaney(mathx.mel_slaney(F.lit(2345.0))).alias("z"), arrays.pre_emphasis(F.array(F.lit(1.0), F.lit(2.0)), 0.5).alias("e"),
    ).first()
    assert r.u == [0.6, 0.8] and r.d == 3 and r.s == [1, 2, 0] and r.p == [1, 0, 0] and r.g == [0, 2, 3] and r.f == 7 and math.isclose(r.z, 2345) and r.e == [0.5, 1.5]


def test_text_functions(spark):
    ev = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert ev(text.polish(F.lit("hello , world..... it is: fine ,. yes ?no"))) == "Hello, world... It is fine. Yes? No"
    assert ev(text.byte_size(F.lit(1536))) == "1.5 KB" and ev(text.byte_size(F.lit(5))) == "5 B" and ev(text.clock(F.lit(6001.2))) == "100:01"
    assert ev(text.base_name(F.lit("/a/b.c/song.final.wav"))) == "song.final" and ev(text.extension(F.lit("a/b.WAV"))) == "wav" and ev(text.extension(F.lit("noext"))) == ""
    assert ev(text.display_name(F.lit(" a/\n b "))) == "a b" and ev(text.display_name(F.lit(None).cast("string"))) == "untitled"
    assert ev(text.nth_word_end(F.lit("one two  three"), F.lit(2))) == 7 and ev(text.nth_word_end(F.lit("a b"), F.lit(0))) == 0
    assert ev(text.words_match(F.lit("hello"), F.lit("hallo"))) and not ev(text.words_match(F.lit(""), F.lit("a"))) and ev(text.words_match(F.lit(""), F.lit("")))
    assert ev(udfs.nfc(F.lit("é"))) == "é"
    udfs.register(spark)
    assert spark.sql("select nfkc('ﬁ')").first()[0] == "fi"


def test_vocabularies(spark, tmp_path):
    (tmp_path / "tokens.txt").write_text("<blk> 0\n▁the 1\nbad line\na b 7\n")
    t = files.token_table(files.lines(spark, str(tmp_path / "tokens.txt")))
    assert sorted((r.piece, r.id) for r in t.collect()) == [("<blk>", 0), ("a b", 7), ("▁the", 1)]
    (tmp_path / "bpe.vocab").write_text("▁the\t-1.5\nzzz\t-9\r\n")
    p = files.piece_scores(files.lines(spark, str(tmp_path / "bpe.vocab")), t).collect()
    assert [(r.piece, r.score, r.id, r.longest) for r in p] == [("▁the", -1.5, 1, 4)]
    (tmp_path / "vocab").write_text("a\n\nb\n")
    assert [(r.id, r.token) for r in files.vocabulary(files.lines(spark, str(tmp_path / "vocab"))).orderBy("id").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "hot").write_text("# no\nxin  chào :3.5\nplain: text\n\nbig :99\n")
    h = files.phrases(files.lines(spark, str(tmp_path / "hot")))
    assert [(r.phrase, r.score) for r in h.collect()] == [("XIN CHÀO", 3.5), ("PLAIN: TEXT", 1.5), ("BIG", 8.0)]
    assert [r.line for r in files.phrase_lines(h).collect()][0] == "XIN CHÀO :3.5"


def test_tokens_and_search():
    assert tokens.unigram("Hello hello", {"▁Hello": -1.0, "▁hel": -1.0, "lo": -1.0, "▁": -3.0}) == ["▁Hello", "▁hel", "lo"]
    assert tokens.unigram("", {}) == [] and tokens.unigram("é", {"▁": -1.0}) == ["▁", "é"]
    v = {"un", "##aff", "##able", "a"}
    assert tokens.word_pieces("unaffable", v) == ["un", "##aff", "##able"] and tokens.word_pieces("unx", v) == ["[UNK]"] and tokens.word_pieces("a" * 101, v) == ["[UNK]"]
    g = tokens.PhraseGraph([([1, 2, 3], 1.0), ([2, 4], 2.0)])
    gain, node = 0.0, g.root
    for t in (1, 2, 4):
        more, node = g.forward(node, t)
        gain += more
    assert math.isclose(gain + g.finish(node), 4.0)  # the second phrase, found at the first one's fail link
    gain, node = g.forward(g.root, 1)
    assert math.isclose(gain + g.finish(node), 0.0)
    once = tokens.PhraseGraph([([3, 5], 1.0), ([3, 5, 7], 1.0)])
    gain, node = 0.0, once.root
    for t in (3, 5, 7):
        more, node = once.forward(node, t)
        gain += more
    assert node is once.root and math.isclose(gain + once.finish(node), 2.0)  # the shorter phrase ends the longer
    inner = tokens.PhraseGraph([([1, 2, 3, 4], 1.0), ([2, 3], 5.0)])
    gains, node = [], inner.root
    for t in (1, 2, 3, 4):
        more, node = inner.forward(node, t)
        gains.append(more)
    assert gains == [1.0, 1.0, 8.0, 0.0] and node is inner.root  # the path is given up for the phrase within it
    lp = np.log(np.array([[0.5, 0.4, 0.1], [0.1, 0.6, 0.3], [0.8, 0.1, 0.1]]))
    best = {}
    for path in np.ndindex(3, 3, 3):
        key = tuple(p for p in path if p)
        best[key] = np.logaddexp(best.get(key, -np.inf), sum(lp[i, p] for i, p in enumerate(path)))
    want = max(best, key=lambda k: best[k] / (len(k) + 2))
    assert tokens.beam_search(lp, beam=27).tokens == want
    assert tokens.context_tokens([0, 0, 5, 0, 7]) == [5, 7]


def test_library(spark, tmp_path):
    for i, meta in enumerate([{"id": "a", "source_file": "x.wav", "updated_ms": 5}, {"id": "b"}, {"id": "c", "source_file": "y.wav", "display_name": "Y", "status": "complete", "updated_ms": 9}]):
        (tmp_path / f"i{i}").mkdir()
        (tmp_path / f"i{i}" / "metadata.json").write_text(json.dumps(meta))
    (tmp_path / "i9").mkdir()
    (tmp_path / "i9" / "metadata.json").write_text("{broken")
    items = files.catalogue(spark, str(tmp_path / "*" / "metadata.json"))
    assert [(r.id, r.display_name, r.status) for r in catalog.newest(items).collect()] == [("c", "Y", "complete"), ("a", "untitled", "processing")]
    assert [r.id for r in catalog.unfinished(items, items.where("id = 'x'")).collect()] == ["a"]
    changed = catalog.set_status(items, spark.createDataFrame([("a", "error", 7), ("a", "complete", 8), ("z", "error", 1)], "id string, status string, updated_ms long"))
    assert {r.id: r.status for r in changed.collect()} == {"a": "complete", "c": "complete"}
    man = spark.createDataFrame([("m1", 3, None), ("m2", 3, "00"), ("m3", 4, None), ("m4", 0, "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD")], "path string, bytes long, sha256 string")
    f = spark.createDataFrame([(p, bytearray(b"abc")) for p in ("m1", "m2", "m3", "m4")][:4], "path string, content binary")
    assert {r.path: r.state for r in catalog.verified(man, f.where("path <> 'm1'")).collect()} == {"m1": "missing", "m2": "wrong hash", "m3": "wrong size", "m4": "ok"}
    new = catalog.imported(spark.createDataFrame([("a/b.wav", 5)], "name string, bytes long"), F.lit(7).cast("long")).first()
    assert new.display_name == "b" and new.status == "processing" and len(new.id) == 36
    r = spark.createDataFrame([("a", '{"x":1}'), ("b", "{}")], "id string, json string")
    files.save_results(r, str(tmp_path / "out"), "id")
    files.save_results(r.where("id = 'b'").withColumn("json", F.lit("[]")), str(tmp_path / "out"), "id")
    assert sorted((x.id, x.json) for x in files.read_results(spark, str(tmp_path / "out"), "id").collect()) == [("a", '{"x":1}'), ("b", "[]")]
    files.save_stage(r, str(tmp_path / "ck"), "a", "vad")
    assert files.read_stage(spark, str(tmp_path / "ck"), "a", "vad").count() == 2
    assert files.media_only(spark.createDataFrame([("a.WAV",), ("b.txt",)], "path string")).count() == 1
    (tmp_path / "man.json").write_text(json.dumps({"files": [{"id": "x", "path": "p", "bytes": 3}]}))
    assert files.manifest(spark, str(tmp_path / "man.json")).first().bytes == 3


def test_audio(spark, tmp_path):
    x = signal.diagnostic_signal(3000)
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(x, channels=2))
    (tmp_path / "b.wav").write_bytes(audio.wav_bytes(x, rate=8000))
    (tmp_path / "c.f32").write_bytes(x.astype("<f4").tobytes())
    (tmp_path / "d.wav").write_bytes(b"RIFFxxxx")
    rows = {r.path[-5:]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert np.allclose(rows["a.wav"].samples, x, atol=1e-4) and rows["a.wav"].channels == 2 and rows["a.wav"].decoder == "wav"
    assert rows["b.wav"].samples is None and rows["d.wav"].samples is None and np.allclose(rows["c.f32"].samples, x, atol=1e-6)
    odd = audio.wav_bytes(x)
    odd = odd[:12] + b"LIST\x03\x00\x00\x00abc\x00" + odd[12:]
    assert len(audio.parse_wav(odd)[0]) == 3000
    audio.register(spark)
    b = spark.read.format("talkspan_pcm").options(path=str(tmp_path / "c.f32"), blockSize=1000).load()
    assert [len(r.samples) for r in b.orderBy("block_no").collect()] == [1000] * 3
    uri = spark.read.format("talkspan_pcm").options(path=(tmp_path / "c.f32").as_uri(), blockSize=1000).load()
    assert sorted(map(repr, uri.collect())) == sorted(map(repr, b.collect()))
    assert spark.read.format("talkspan_pcm").options(path=str(tmp_path / "c.f32"), blockSize=1000, firstBlock=1, lastBlock=1).load().first().block_no == 1
    assert audio.blocks(audio.read_audio(spark, str(tmp_path / "c.f32")), "path", 1024).count() == 3
    np.save(tmp_path / "v.npy", np.arange(6, dtype="<f4").reshape(2, 3))
    np.savez(tmp_path / "w.npz", p=np.ones(2), q=np.zeros((1, 2)))
    (tmp_path / "arrays").mkdir()
    for n in ("v.npy", "w.npz"):
        (tmp_path / n).rename(tmp_path / "arrays" / n)
    got = {r.name: (r.shape, r.data) for r in audio.read_arrays(spark, str(tmp_path / "arrays")).collect()}
    assert got == {"v": ([2, 3], [0, 1, 2, 3, 4, 5]), "p": ([2], [1, 1]), "q": ([1, 2], [0, 0])}
    buf = io.BytesIO()
    np.save(buf, np.arange(3))
    with pytest.raises(ValueError):
        audio._array(buf.getvalue())
    assert zipfile.is_zipfile(tmp_path / "arrays" / "w.npz")


def test_streams_equal_batches(spark, tmp_path):
    x = np.random.default_rng(5).random(5000)
    rows = spark.createDataFrame([(i, s, x[s * 700 : s * 700 + 700].tolist(), s == 7) for i in (1, 2) for s in range(8)] + [(1, 8, [1.0] * 700, False)], "item_id long, seq long, samples array<double>, end boolean")
    for n in range(3):
        rows.where(f"seq div 3 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for snip in (True, False):
        o = signal.FrameOptions(snip_edges=snip)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = streams.drained(streams.online_frames(stream, o), f"file://{tmp_path}/f{snip}").orderBy("item_id", "frame_no").collect()
        want = signal.framed(x, o)
        assert len(out) == 2 * len(want)
        assert np.allclose([r.frame for r in out[: len(want)]], want)
        assert not any(r.last for r in out if r.frame_no + 1 < len(want)) and (snip or out[-1].last)
    windows = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("item_id", "seq", "samples")
    s = streams.drained(streams.online_scores(windows, lambda: [0.0], lambda c, v: (c * 0.5 + v.mean(), float(c[0]))), f"file://{tmp_path}/s").where("item_id = 2").orderBy("seq").collect()
    carried, want = 0.0, []
    for n in range(8):
        want.append(carried)
        carried = carried * 0.5 + x[n * 700 : n * 700 + 700].mean()
    assert np.allclose([r.prob for r in s], want)


def test_framer_drops_what_is_used():
    f = streams.Framer(signal.FrameOptions())
    assert f.accept(np.zeros(399)) == [] and len(f.accept(np.zeros(1))) == 1
    for _ in range(50):
        f.accept(np.zeros(1000))
    assert len(f.buffer) < 2000
    f.accept(np.zeros(0), end=True)
    assert f.accept(np.zeros(1000)) == []


def test_scorers(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0]), (1, 2, None)], "k long, i long, v array<double>")
    got = scoring.scored(v, "v", lambda: lambda x: x[:, :1] * 2).orderBy("i").collect()
    assert [r.scores for r in got] == [[2.0], [6.0], None]
    r = scoring.recurrent(v.where("i < 2"), "k", "i", "v", lambda: 0.0, lambda s, x: (s + x.sum(), s)).orderBy("i").collect()
    assert [x.prob for x in r] == [0.0, 3.0]
    a = signal.affine(v.where("i = 0"), "v", np.eye(2) * 3, np.ones(2)).first()
    assert a.v == [4.0, 7.0]


def test_documents(spark):
    d = spark.createDataFrame([(1, '{"text":"t","segments":[{"speaker_id":2,"start":1.5,"end":2.0,"text":"x"}]}'), (2, '{"text":"t","words":[{"text":"w","start":0.1,"end":0.2}]}'), (3, '{"text":"only"}'), (4, "broken"), (5, "{}")], "k long, json string")
    got = [(r.k, r.speaker, r.start_ms, r.text, r.level) for r in edits.parsed(d, "k").orderBy("k").collect()]
    assert got == [(1, 2, 1500, "x", 1), (2, 0, 100, "w", 2), (3, 0, 0, "only", 3)]


def test_settings():
    s = Settings.of({"threads": 99, "beam": 0, "unknown": 1, "phrase_score": None})
    assert (s.threads, s.beam, s.phrase_score) == (8, 1, 1.5)


def test_features_side_by_side(spark):
    """Batches of several items and kernels hold what each kernel gives for each item, empty and null samples nothing."""
    rng = np.random.default_rng(0)
    items = {1: rng.normal(size=700).tolist(), 2: None, 3: [], 4: rng.normal(size=90).tolist(), None: rng.normal(size=500).tolist()}
    kernels = {"a": lambda x: signal.raw_frames(x, 100, 50), "b": lambda x: signal.raw_frames(x, 40, 40)[:, :7]}
    df = spark.createDataFrame(list(items.items()), "item_id int, samples array<double>").coalesce(1)
    got = sorted((str(r.item_id), r.kind, r.frame_no, tuple(r.mel)) for r in signal.side_by_side(df, kernels, "kind").collect())
    want = [(str(k), name, n, tuple(m.astype(np.float32).tolist())) for k, x in items.items() if x for name, f in kernels.items() for n, m in enumerate(f(np.array(x)))]
    assert got == sorted(want)
    assert signal.features(df, kernels["a"]).columns == ["item_id", "frame_no", "mel"]
