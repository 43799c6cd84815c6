"""The pipeline's stages against brute force, and the registered queries over the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from talkspan.llm import linededup, mixing, pieces, shingles, simhash
from tests.llm.test_operators import docs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in d.collect()}
    one = corpus_pipeline.quality_stage(spark, d, SF)
    kept = {r.doc_id for r in one.collect()}
    clean = {i for i, x in labels.items() if x.quality == 1 and not x.toxic}
    assert len(clean & kept) >= 0.97 * len(clean)
    two = corpus_pipeline.line_stage(spark, one, SF)
    marks = {(r.doc_id, r.row_key): r for r in linededup.keep_bitmaps(one).collect()}
    dropped = {i: m.n_dropped for (i, _), m in marks.items()}
    for r in two.collect():
        lines = before[r.doc_id].split("\n")
        assert len(lines) - dropped.get(r.doc_id, 0) == (len(r.text.split("\n")) if r.text or dropped.get(r.doc_id, 0) < len(lines) else 0)
        assert r.n_chars == len(r.text)
    three = corpus_pipeline.simhash_stage(spark, two, SF)
    rows = two.orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in three.collect()) == [rows[i].doc_id for i in sorted(set(brute_roots([r.text for r in rows])))]
    four = corpus_pipeline.mix_stage(spark, three, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    assert Counter(r.doc_id for r in four.collect()) == {i: n for i, n in copies.items() if n}
    five = corpus_pipeline.pieces_stage(spark, four, SF)
    model, texts = pieces.load(), {r.doc_id: r.text for r in four.collect()}
    rows = five.collect()
    assert len(rows) == four.count() and all(r.round_trip and pieces.decode(model, r.ids) == texts[r.doc_id] for r in rows)
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in (one, two, three, four))
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_quality_stage_rejects(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    junk = {r.doc_id for r in labels if r.quality == 0}
    clean = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    assert len(junk & kept) <= 0.05 * len(junk) and len(clean & kept) >= 0.98 * len(clean)


@pytest.mark.parametrize("stage", range(1, 5))
def test_stages_take_odd_rows(spark, stage):
    from tests.llm.test_operators import ODD

    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, docs(spark, ODD), SF).count() >= 1
    assert f(spark, docs(spark, []), SF).count() == 0


def test_quality_stage_takes_odd_rows(spark):
    from tests.llm.test_operators import ODD

    assert corpus_pipeline.quality_stage(spark, docs(spark, ODD), SF).count() <= len(ODD)
    assert corpus_pipeline.quality_stage(spark, docs(spark, []), SF).count() == 0


def test_near_copies_go(spark):
    text = " ".join(f"word{i}" for i in range(500))
    rows = [(1, text, "a"), (2, text, "a"), (3, text.replace("word250 ", "changed "), "a"), (4, "another text altogether with its own words", "a")]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs(spark, rows), SF).collect()) == [1, 4]


def changed(text, times, word="changed"):
    """text with `times` words replaced, far apart."""
    words = text.split()
    for i in range(times):
        words[20 + i * 40] = f"{word}{i}"
    return " ".join(words)


def test_copies_of_four_fifths_go(spark):
    text = " ".join(f"word{i}" for i in range(500))
    rows = [(1, text, "a"), (2, changed(text, 10), "a"), (3, changed(text, 12, "other"), "a")]  # five-word Jaccard 0.82 and 0.78
    near = [(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[i][1])).bit_count() for i in (1, 2)]
    assert min(near) > 4
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs(spark, rows), SF).collect()) == [1, 3]


def brute_roots(texts):
    """Each text's smallest index by links of Jaccard 0.8 or more."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for y in w for x in y.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_components_by_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["", "  \n", "one two", "One two", "one two three"]
    for f in range(12):  # families: chains of copies, each some words away from one before
        family = [" ".join(f"f{f}w{rng.randrange(400)}" for _ in range(120 + 30 * f))]
        for _ in range(14):
            w = rng.choice(family).split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            family.append(" ".join(w))
        texts += family
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    want = brute_roots(texts)
    d = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for tile in (1024, 4):
        out = shingles.near_duplicates(d, tile=tile).collect()
        key = {r.doc_id: r.key for r in d.select("doc_id", shingles.row_key().alias("key")).collect()}
        root = {r.key: r.root for r in out}
        assert len(out) == len(set(texts))
        first = {}
        assert [first.setdefault(root[key[i]], i) for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, d, SF).collect()) == sorted(set(want))


def test_null_ids_fall_under_their_component(spark):
    text, other = (" ".join(f"{p}{i}" for i in range(500)) for p in ("word", "other"))
    rows = [(7, text, "a"), (None, text, "a"), (None, changed(text, 3), "a"), (None, other, "a"), (None, changed(other, 3), "a"), (7, "a text of its own under the same id", "a")]
    out = corpus_pipeline.simhash_stage(spark, docs(spark, rows), SF).collect()
    assert Counter(r.doc_id for r in out) == {7: 2, None: 1}
    assert {r.text for r in out if r.doc_id == 7} == {text, rows[5][1]}


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, f"null text {i} " + "word " * i, "abc"[i % 3]) for i in range(30)] + [(5, "first text", "a"), (5, "second longer text", "a"), (6, "alike", "b"), (6, "alike", "b"), (7, None, "b"), (7, "", "b")]
    rows += [(100 + i, "some text of a few words", "abc"[i % 3]) for i in range(40)]
    d = docs(spark, rows)
    taken = mixing.mix(d).groupBy("source").agg({"copies": "sum"}).collect()
    out = corpus_pipeline.mix_stage(spark, d, SF).collect()
    assert Counter(r.source for r in out) == {r.source: r["sum(copies)"] for r in taken if r["sum(copies)"]}
    assert max(Counter((r.doc_id, r.text) for r in out).values()) <= 4 and {(r.doc_id, r.text, r.source) for r in out} <= set(rows)
    sizes, words = {r.source: r.target for r in mixing.mix(d).collect()}, Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    assert all(abs(words[s] - t) <= 40 for s, t in sizes.items())


@pytest.mark.parametrize("name", ["op1_quality", "op2_tokens", "op3_secrets", "op4_topk", "op5_mix", "op6_simhash", "op7_pieces", "op8_licenses", "op9_lines", "op10_embeddings"])
def test_registered(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    first = rows.columns[0]
    table = "embeddings" if first in ("vec_id", "query_id") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows.count() == (n if first != "query_id" else 20 * ((n + 19) // 20))
