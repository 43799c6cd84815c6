"""Queries on signals, tokens, scores and streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.operators import scoring, sequences, signal, tokens
from talkspan.plans import fixtures as fx
from talkspan.plans.fixtures import sql
from talkspan.plans.registry import query
from talkspan.streaming import frames as streams

RATE, LENGTH = 16_000, 4_000


def half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """x as SQL rounds it: halves away from zero, and what rounds to zero keeps its sign, which Spark's round() drops."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    return np.copysign((low + (y - low >= 0.5)) / 10.0**digits, x)


#: Items of a task, which bounds its batches as well; items whose samples are made at a time; samples of a block.
ITEMS, AT_ONCE, BLOCK = 1024, 64, 64


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, samples: a quarter of a second of three tones, one item per customer, whose key shifts and scales them.

    Items are dealt out before they have samples: the table's few small files would be as few tasks.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.arange(BLOCK)[None, :, None], np.arange(0, LENGTH, BLOCK)[:, None, None]
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                ids = b.column(0).slice(at, AT_ONCE)
                key = ids.to_numpy(zero_copy_only=False)  # nulls are nan here, and their samples null
                x = np.empty((len(ids), LENGTH))
                for row, gain, up in zip(x, np.fmod(key, 7) + 1.0, np.fmod(key, 50) + 0.0, strict=True):
                    w = 2 * np.pi * (up + np.array((233.0, 701.0, 1234.5))) / RATE
                    a, b_ = high * w, low * w  # sin(a + b), by the sines and cosines of blocks and of places in a block
                    left = np.concatenate((np.sin(a), np.cos(a)), 2)[:, 0] * np.tile((0.07, 0.03, 0.01), 2)
                    right = np.concatenate((np.cos(b_), np.sin(b_)), 2)[0]
                    row[:] = gain * (left @ right.T).ravel()[:LENGTH]
                samples = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * LENGTH, pa.int32()), pa.array(x.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([ids, samples], ["item_id", "samples"])

    items = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("item_id"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // ITEMS))
    return items.repartition(tasks, "item_id").mapInArrow(made, "item_id long, samples array<double>")


#: The samples of signals(), a row each, for DuckDB.
_SAMPLES = f"""select item_id, i, (item_id % 7 + 1) * (0.07e0 * sin(i * (2 * pi() * (item_id % 50 + 233.0e0) / {RATE})) + 0.03e0 * sin(i * (2 * pi() * (item_id % 50 + 701.0e0) / {RATE}))
    + 0.01e0 * sin(i * (2 * pi() * (item_id % 50 + 1234.5e0) / {RATE}))) as x from (select cast(c_custkey as bigint) as item_id from customer), (select unnest(range({LENGTH})) as i)"""


@query(f"select item_id, count(*) as n, round(sum(x), 5) + 0.0e0 as total, round(max(abs(x)), 6) as peak, round(sqrt(sum(x * x) / count(*)), 6) as rms from ({_SAMPLES}) group by item_id")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    s, n = signals(spark, sf_dir), F.size("samples")
    squares = add(F.transform("samples", lambda x: x * x))
    return s.select(
        "item_id", n.cast("long").alias("n"), (F.round(add("samples"), 5) + 0.0).alias("total"), F.round(F.array_max(F.transform("samples", lambda x: F.abs(x))), 6).alias("peak"),
        F.round(F.sqrt(squares / n), 6).alias("rms"),
    )


@query()
def frame_fbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = signal.FbankOptions(mel_opts=signal.MelOptions(num_bins=80))
    return signal.features(signals(spark, sf_dir), lambda x: signal.fbank(x, o))


@query()
def frame_mfcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.features(signals(spark, sf_dir), lambda x: signal.mfcc(x, signal.MfccOptions()))


@query()
def whisper_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.features(signals(spark, sf_dir), lambda x: signal.whisper_mel(x, 80))


@query()
def preset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three presets side by side."""
    return signal.side_by_side(signals(spark, sf_dir), {p: partial(signal.preset_features, name=p) for p in ("recognition", "campp", "wespeaker")}, "preset")


@query("select cast(c_custkey as bigint) as item_id, true as same from customer")  # what an inverse must give
def stft_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra and back: the greatest difference."""

    def kernel(x: np.ndarray) -> np.ndarray:
        o = signal.StftOptions(n_fft=512, hop_length=128, win_length=512)
        y = signal.istft(signal.stft(x, o), o)
        n = min(len(x), len(y))
        return np.array([[np.abs(x[:n] - y[:n]).max()]])

    return signal.features(signals(spark, sf_dir), kernel).select("item_id", (F.col("mel")[0] < 1e-6).alias("same"))


@query(f"""
select item_id, i // 30 as frame_no, sum(round(x, 6)) > 5e-7 as positive from ({_SAMPLES}) where i < {LENGTH // 30 * 30} group by all""")
def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x: np.ndarray) -> np.ndarray:
        return half_away(signal.raw_frames(x, 30, 30), 6).sum(1, keepdims=True)  # multiples of a millionth

    return signal.features(signals(spark, sf_dir), kernel).select("item_id", F.col("frame_no").cast("long").alias("frame_no"), (F.col("mel")[0] > 5e-7).alias("positive"))


@query(sql("""
with v as (select '▁' || lower(tok[1:3]) as piece, ln(count(*)) - 12 as score from fx_words group by lower(tok[1:3]) order by count(*) desc, lower(tok[1:3]) limit 500),
w as (select conv_id, pos, lower(tok) as t from fx_words),
k as (select conv_id, pos, t, unnest(range(0, 4)) as k from w),
c as (select conv_id, pos, t, k, case when k = 0 then coalesce(v.score, -8.0e0) else v.score end
    + coalesce(list_sum(list_transform(string_split(t[k + 1:], ''), lambda x: case when x = '' then 0.0e0 when regexp_matches(x, '^[a-z▁]$') then -8.0e0 else -20.0e0 end)), 0.0e0) as score
  from k left join v on v.piece = '▁' || t[1:k] where k <= length(t)),
b as (select * from c where score is not null qualify row_number() over (partition by conv_id, pos order by score desc, k desc) = 1)
select conv_id, pos, list_concat(['▁' || t[1:k]], list_filter(string_split(t[k + 1:], ''), lambda x: x <> '')) as pieces from b""", "fx_words"))
def unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in pieces of a vocabulary made of frequent prefixes and letters: fixed in size."""
    w = fx.words(spark, sf_dir)
    top = w.groupBy(F.lower(F.substring("tok", 1, 3)).alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(500).collect()
    vocab = {c: -8.0 for c in "abcdefghijklmnopqrstuvwxyz▁"} | {("▁" + r["p"]): float(np.log(r["n"])) - 12 for r in top}
    return sequences.each(w.select("conv_id", "pos", "tok"), lambda conv, pos, tok: (conv, pos, tokens.unigram(tok.lower(), vocab)), f"conv_id {dict(w.dtypes)['conv_id']}, pos long, pieces array<string>")


#: A fixed vocabulary: beginnings of words and, with ##, what may follow.
_PIECES = ("the", "and", "th", "in", "##e", "##er", "##in", "##th", "##on", "##an", "##ed", "##s", "##re", "##ou", "##ly", "##ha", "##at", "##ing", "##en", "##st", "##or", "##ti", "##ea", "er", "on", "re", "ou", "an", "ha", "at")
_FIRST = "|".join(sorted((p for p in _PIECES if not p.startswith("##")), key=len, reverse=True))
_LATER = "|".join(sorted((p[2:] for p in _PIECES if p.startswith("##")), key=len, reverse=True))


@query(sql(f"""
with a as (select conv_id, pos, lower(tok) as t, regexp_extract(lower(tok), '^({_FIRST})') as f from fx_words),
b as (select *, regexp_extract_all(t[length(f) + 1:], '{_LATER}') as l from a)
select conv_id, pos, case when f = '' or length(t) > 100 or f || coalesce(array_to_string(l, ''), '') <> t then ['[UNK]'] else list_concat([f], list_transform(l, lambda x: '##' || x)) end as pieces from b""", "fx_words"))
def word_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, w = set(_PIECES), fx.words(spark, sf_dir)
    return sequences.each(w.select("conv_id", "pos", "tok"), lambda conv, pos, tok: (conv, pos, tokens.word_pieces(tok.lower(), vocab)), f"conv_id {dict(w.dtypes)['conv_id']}, pos long, pieces array<string>")


@query()
def biased_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam search over embeddings read as log-probabilities of 16 tokens in four frames, with and without phrases."""
    graph = tokens.PhraseGraph([([3, 5], 1.0), ([5, 7, 2], 2.0)])

    def one(v: np.ndarray) -> tuple[list[int], list[int]]:
        x = np.asarray(v, float).reshape(4, 16) * 8
        lp = x - np.log(np.exp(x).sum(1, keepdims=True))
        return list(tokens.beam_search(lp).tokens), list(tokens.beam_search(lp, graph=graph).tokens)

    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return sequences.each(e, lambda i, v: (i, *one(v)), "vec_id long, plain array<int>, biased array<int>")


@query(sql("""
with a as (select item_id, win_no, vector, list(vector[1]) over (partition by item_id order by win_no) as firsts from fx_windows),
s as (select item_id, win_no, vector, list_sum(list_transform(range(1, len(firsts) + 1), lambda i: firsts[i] / pow(2.0e0, len(firsts) - i + 1))) as state from a)
select item_id, win_no, list_transform(vector[1:3], lambda x: round(tanh(x), 6)) as scores, round(1 / (1 + exp(-state)), 6) as prob from s""", "fx_windows"))
def pluggable_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer in batches, and a recurrent one along each item's windows."""
    w = fx.windows(spark, sf_dir)
    batch = scoring.scored(w, "vector", lambda: lambda x: half_away(np.tanh(x[:, :3]), 6))
    carried = scoring.recurrent(w, "item_id", "win_no", "vector", lambda: 0.0, lambda s, v: ((s + v[0]) / 2, 1 / (1 + np.exp(-(s + v[0]) / 2))))
    return batch.select("item_id", "win_no", "scores").join(carried.withColumn("prob", F.round("prob", 6)), ["item_id", "win_no"])


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talkspan-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(f"""
select cast(c_custkey as bigint) as item_id, f as frame_no, f * 160 - 120 as first_sample, 400 as n, f = {(LENGTH + 80) // 160 - 1} as last
from customer, (select unnest(range({(LENGTH + 80) // 160})) as f)""")
def online_frames_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals sent in pieces of 1000 samples over several batches: the frames that come out. Later pieces are in later
    files, so a batch may end anywhere between them."""
    folder = _folder(spark)
    pieces = LENGTH // 1000
    s = signals(spark, sf_dir).select("item_id", "samples", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("seq"))
    rows = s.select("item_id", "seq", F.slice("samples", (F.col("seq") * 1000 + 1).cast("int"), 1000).alias("samples"), (F.col("seq") == pieces - 1).alias("end"))
    for n in range(pieces):
        rows.where(F.col("seq") == n).write.mode("append").parquet(f"{folder}/in")
    files = max(1, len(spark.read.parquet(f"{folder}/in").inputFiles()) // pieces)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    out = streams.drained(streams.online_frames(stream, signal.FrameOptions(snip_edges=False)), folder)
    return out.select("item_id", "frame_no", "first_sample", F.size("frame").alias("n"), "last")


@query("""
with a as (select user_id % 16 as item_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id % 16 order by ts, event_id) as p from events),
b as (select *, sum(case when p is null or us - p > 1800000000 then 1 else 0 end) over (partition by item_id order by us) as s from a),
g as (select item_id, min(us) as lo, max(us) as hi, count(*) as n from b group by item_id, s)
select item_id, lo // 1000 as first_ms, hi // 1000 as last_ms, n from g where hi + 1800000000 <= (select max(us) from a)""")
def gap_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the event stream that the watermark has passed when the source is drained."""
    folder = _folder(spark)
    e = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{folder}/in")
    return streams.drained(streams.sessions(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "item_id"), folder)


@query("""
select item_id, ts_ms // 86400000 * 86400000 as start_ms, count(*) as n from (select user_id % 16 as item_id, epoch_us(ts) // 1000 as ts_ms, max(epoch_us(ts)) over () // 1000 as top from events)
where ts_ms // 86400000 * 86400000 + 86400000 <= top group by all""")
def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    e = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{folder}/in")
    return streams.drained(streams.tumbling(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "item_id", "1 day"), folder)


@query()
def chunked_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long items clustered in stretches of ten windows, speakers numbered anew in each."""
    from talkspan.operators import vectors

    w = fx.windows(spark, sf_dir).withColumn("part", F.col("item_id") * 1000 + F.floor(F.col("win_no") / 10))
    return vectors.clustered(w, "part", "win_no", "agglomerative").select(F.floor(F.col("part") / 1000).alias("item_id"), "win_no", "label")


@query(sql("""
with a as (select *, coalesce(sum(end_ - start) over (partition by item_id order by seg_no rows between unbounded preceding and 1 preceding), 0) as pos from fx_segments),
p as (select unnest([0.15e0, 0.5e0, 0.85e0]) as part),
b as (select item_id, seg_no, part, start + greatest(0, cast(1000000 * part as bigint) - pos) as s, least(end_, start + cast(1000000 * part as bigint) + 144160 - pos) as e from a, p)
select item_id, seg_no, cast(s as bigint) as start, cast(e as bigint) as "end", part from b where e > s""", "fx_segments"))
def quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where windows for a quality score would be cut: at 15, 50 and 85 % of each item's speech."""
    from talkspan.operators import joins

    s = fx.segments(spark, sf_dir)
    parts = [joins.timeline_window(s, ["item_id"], "seg_no", int(1_000_000 * p), 144_160).withColumn("part", F.lit(p)) for p in (0.15, 0.5, 0.85)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
