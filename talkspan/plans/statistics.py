"""Queries on aggregates, quality figures and arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.functions import arrays, mathx
from talkspan.plans import fixtures as fx
from talkspan.plans.fixtures import sql
from talkspan.plans.registry import query


def _r(c, digits: int = 6):
    return F.round(c, digits) + 0.0  # no negative zeros


@query(sql("select item_id, round(max(abs(prob)), 6) as peak, round(sqrt(sum(prob * prob) / greatest(1, count(*))), 6) as rms from fx_frames group by all", "fx_frames"))
def energy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("prob")
    return fx.frames(spark, sf_dir).groupBy("item_id").agg(_r(F.max(F.abs(p))).alias("peak"), _r(F.sqrt(F.sum(p * p) / F.greatest(F.lit(1), F.count("*")))).alias("rms"))


def energy_ratio(samples: DataFrame, key: str, size: int = 480) -> DataFrame:
    """key, ratio: share of frames whose RMS reaches 0.6 of the item's, 0.004 at least. samples: key, i, x."""
    x = F.col("x")
    frames = samples.groupBy(key, F.floor(F.col("i") / size).alias("f")).agg(F.sum(x * x).alias("e"), F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    rms = F.sqrt(F.sum("e").over(whole) / F.sum("n").over(whole))
    loud = F.sqrt(F.col("e") / F.col("n")) >= F.greatest(F.lit(0.004), 0.6 * rms)
    return frames.withColumn("loud", loud).groupBy(key).agg(_r(F.count_if("loud") / F.count("*")).alias("ratio"))


@query(sql("""
with f as (select item_id, frame_no // 10 as f, sum(prob * prob) as e, count(*) as n from fx_frames group by all),
r as (select *, sqrt(sum(e) over (partition by item_id) / sum(n) over (partition by item_id)) as rms from f)
select item_id, round(count(*) filter (sqrt(e / n) >= greatest(0.004e0, 0.6e0 * rms)) / count(*), 6) as ratio from r group by all""", "fx_frames"))
def energy_speech_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy_ratio(fx.frames(spark, sf_dir).select("item_id", F.col("frame_no").alias("i"), F.col("prob").alias("x")), "item_id", 10)


@query(sql("select item_id, round(greatest(0, coalesce(max(prob), 0)), 6) as top, round(coalesce(avg(prob), 0), 6) as mean from fx_frames group by all", "fx_frames"))
def probability_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir).groupBy("item_id").agg(_r(F.greatest(F.lit(0.0), F.coalesce(F.max("prob"), F.lit(0.0)))).alias("top"), _r(F.coalesce(F.avg("prob"), F.lit(0.0))).alias("mean"))


@query(sql("select item_id, round(sum(greatest(0, end_ - start)) / 16000.0e0, 4) as seconds from fx_segments group by all", "fx_segments"))
def speech_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.segments(spark, sf_dir).groupBy("item_id").agg(_r(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))) / 16000.0, 4).alias("seconds"))


@query(sql("""select conv_id, round(avg(case when pos % 11 <> 3 then prob end), 6) as confidence, round(coalesce(avg(case when pos < 0 then prob end), 1), 6) as of_none from fx_words group by all""", "fx_words"))
def asr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of finite probabilities (some are made NaN here); the mean of no words is 1."""
    p = F.when(F.col("pos") % 11 == 3, F.lit(float("nan"))).otherwise(F.col("prob"))
    g = fx.words(spark, sf_dir).withColumn("p", p).groupBy("conv_id")
    return g.agg(_r(F.avg(F.when(mathx.finite(F.col("p")), F.col("p")))).alias("confidence"), _r(F.coalesce(F.avg(F.when(F.col("pos") < 0, F.col("prob"))), F.lit(1.0))).alias("of_none"))


@query(sql("select item_id, count(distinct greatest(0, speaker - 1)) as speakers, coalesce(max(speaker), -1) + 1 as next_id from fx_turns group by all", "fx_turns"))
def speaker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct speakers (negative ones count as 0), and the next free id."""
    g = fx.turns(spark, sf_dir).groupBy("item_id")
    return g.agg(F.countDistinct(F.greatest(F.lit(0), F.col("speaker") - 1)).alias("speakers"), (F.coalesce(F.max("speaker"), F.lit(-1)) + 1).alias("next_id"))


@query("""
with d as (select label, 0.1e0 + (vec_id % 7) / 7.0e0 as w, unnest(embedding)::double as x, unnest(range(64)) as dim from embeddings),
m as (select label, dim, sum(w * x) as wx, sum(w) + 1e-8 as v1, sum(w * w) as v2 from d group by all),
s as (select d.label, d.dim, any_value(wx / v1) as mean, any_value(v1) as v1, any_value(v2) as v2, sum(w * power(x - wx / v1, 2)) as ss from d join m on d.label = m.label and d.dim = m.dim group by d.label, d.dim)
select label, cast(dim as integer) as dim, round(mean, 6) as mean, round(sqrt(greatest(0, ss / (v1 - v2 / v1 + 1e-8))), 6) as std from s""")
def weighted_stats_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and unbiased standard deviation of each dimension, in one pass over sums."""
    e = fx.table(spark, sf_dir, "embeddings").select("label", (0.1 + (F.col("vec_id") % 7) / 7.0).alias("w"), F.posexplode("embedding").alias("dim", "x"))
    w, x = F.col("w"), F.col("x").cast("double")
    g = e.groupBy("label", "dim").agg(F.sum(w * x).alias("wx"), (F.sum(w) + 1e-8).alias("v1"), F.sum(w * w).alias("v2"), F.sum(w * x * x).alias("wxx"), F.sum(w).alias("sw"))
    mean = F.col("wx") / F.col("v1")
    ss = F.col("wxx") - 2 * mean * F.col("wx") + mean * mean * F.col("sw")
    return g.select("label", "dim", _r(mean).alias("mean"), _r(F.sqrt(F.greatest(F.lit(0.0), ss / (F.col("v1") - F.col("v2") / F.col("v1") + 1e-8)))).alias("std"))


@query(sql("select item_id, frame_no, round(prob - avg(prob) over (partition by item_id, frame_no % 8) + 1e-9, 6) as centred from fx_frames", "fx_frames"))
def cmvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean subtraction per item and bin."""
    mean = F.avg("prob").over(Window.partitionBy("item_id", F.col("frame_no") % 8))
    return fx.frames(spark, sf_dir).select("item_id", "frame_no", F.round(F.col("prob") - mean + 1e-9, 6).alias("centred"))


def _calibrated(name: str, a: float, b: float, c: float) -> str:
    return f"least(5.0e0, greatest(1.0e0, ({name} * {a}e0 + {b}e0) * {name} + {c}e0))"


#: Second, first and zeroth coefficients of each figure.
CALIBRATION = {"sig": (-0.08397278, 1.22083953, 0.0052439), "bak": (-0.13166888, 1.60915514, -0.39604546), "ovrl": (-0.06766283, 1.11546468, 0.04602535)}


@query("""
with raw as (select user_id % 16 as item_id, event_id % 3 as win, 1 + (value * 7 + event_id % 13) % 4 as x from events),
s as (select item_id, win, avg(x) as x from raw group by all),
c as (select item_id, """ + ", ".join(f"avg({_calibrated('x', *k)}) as {n}" for n, k in CALIBRATION.items()) + """ from s group by all)
select item_id, """ + ", ".join(f"floor({n} * 100 + 0.5) / 100 as {n}" for n in CALIBRATION) + """,
  case when floor(ovrl * 100 + 0.5) / 100 >= 4 then 'good' when floor(ovrl * 100 + 0.5) / 100 >= 3 then 'fair' when floor(ovrl * 100 + 0.5) / 100 >= 2 then 'poor' else 'bad' end as bucket from c""")
def dnsmos_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores of up to three windows: calibrated, clipped to 1..5, averaged, rounded half up, and bucketed."""
    e = fx.table(spark, sf_dir, "events")
    raw = e.select((F.col("user_id") % 16).alias("item_id"), (F.col("event_id") % 3).alias("win"), (1 + (F.col("value") * 7 + F.col("event_id") % 13) % 4).alias("x"))
    s = raw.groupBy("item_id", "win").agg(F.avg("x").alias("x"))
    c = s.groupBy("item_id").agg(*[mathx.round_half_up(F.avg(mathx.clamp(mathx.quadratic(F.col("x"), *k), 1.0, 5.0))).alias(n) for n, k in CALIBRATION.items()])
    o = F.col("ovrl")
    return c.withColumn("bucket", F.when(o >= 4, "good").when(o >= 3, "fair").when(o >= 2, "poor").otherwise("bad"))


@query("""
select doc_id, case when c >= 0.8 then 'high' when c >= 0.6 then 'medium' else 'low' end as confidence,
  case when l <= 2 then 'very low' when l <= 4 then 'low' when l <= 6 then 'medium' when l <= 8 then 'high' else 'very high' end as level,
  round(0.5 - (l - 1) * 1.3 / 9, 6) as punctuation, round(-1.5 + (l - 1) * 2 / 9, 6) as letters, l <= 1 as bypass
from (select doc_id, (doc_id * 37 % 100) / 100.0e0 as c, least(10, greatest(1, doc_id % 13)) as l from labels)""")
def quality_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 37 % 100) / 100).alias("c"), mathx.clamp(F.col("doc_id") % 13, 1, 10).alias("l"))
    p, k = mathx.level_confidence(F.col("l"))
    c, n = F.col("c"), F.col("l")
    return rows.select(
        "doc_id", F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low").alias("confidence"),
        F.when(n <= 2, "very low").when(n <= 4, "low").when(n <= 6, "medium").when(n <= 8, "high").otherwise("very high").alias("level"),
        _r(p).alias("punctuation"), _r(k).alias("letters"), (n <= 1).alias("bypass"),
    )


@query(sql("select item_id, count(*) as n, round(sum(prob), 4) as total, round(sum(abs(prob)), 4) as total_abs, min(prob) as least, max(prob) as most, list(prob order by frame_no)[1:4] as head from fx_frames group by all", "fx_frames"))
def array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("frame_no") < 4, F.struct("frame_no", "prob")))), 1, 4), lambda x: x["prob"])
    g = fx.frames(spark, sf_dir).groupBy("item_id")
    return g.agg(F.count("*").alias("n"), _r(F.sum("prob"), 4).alias("total"), _r(F.sum(F.abs("prob")), 4).alias("total_abs"), F.min("prob").alias("least"), F.max("prob").alias("most"), head.alias("head"))


@query(sql("""
with h as (select conv_id, tok[1:2] as prefix, ln(prob + 0.01) as lp from fx_words),
m as (select conv_id, prefix, max(lp) as top from h group by all)
select h.conv_id, h.prefix, round(any_value(top) + ln(sum(exp(lp - top))), 6) + 0.0e0 as lp, count(*) as n from h join m on h.conv_id = m.conv_id and h.prefix = m.prefix group by h.conv_id, h.prefix""", "fx_words"))
def hypothesis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses of one prefix joined by log-sum-exp; log-probabilities are bounded, so one pass is stable."""
    h = fx.words(spark, sf_dir).select("conv_id", F.substring("tok", 1, 2).alias("prefix"), F.log(F.col("prob") + 0.01).alias("lp"))
    return h.groupBy("conv_id", "prefix").agg(_r(F.log(F.sum(F.exp("lp")))).alias("lp"), F.count("*").alias("n"))


@query(sql("select turn_no // 100 as chunk, item_id, round(max(case when speaker = 2 then (event_id * 37 % 100) / 100.0e0 end), 6) as top_error from fx_turns group by all", "fx_turns"))
def error_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("speaker") == 2, (F.col("event_id") * 37 % 100) / 100)
    return fx.turns(spark, sf_dir).groupBy(F.floor(F.col("turn_no") / 100).alias("chunk"), "item_id").agg(_r(F.max(p)).alias("top_error"))


@query(sql("select status, count(*) > 0 and bool_and(source_bytes > 100) as all_selected, count(*) filter (source_bytes > 100) as selected, count(*) as visible from fx_library group by all", "fx_library"))
def all_visible_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("source_bytes") > 100
    return fx.library(spark, sf_dir).groupBy("status").agg(((F.count("*") > 0) & F.bool_and(big)).alias("all_selected"), F.count_if(big).alias("selected"), F.count("*").alias("visible"))


@query("""
select vec_id, list_position(p, list_max(p)) - 1 as best, round(p[list_position(p, list_max(p))], 6) as p, list_position(r, list_max(r)) - 1 as raw_best
from (select vec_id, list_transform(range(1, 6), lambda i: greatest(1e-12, exp(v[i] - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) + case when i = 1 then 0.1 else 0 end) as p, v as r
  from (select vec_id, list_transform(embedding[1:5], lambda x: cast(x as double) * 10) as v from embeddings))""")
def softmax_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax, a bias on the first class after it, and the first greatest class."""
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 10).alias("v"))
    p = v.withColumn("s", arrays.softmax(F.col("v"))).withColumn("p", F.transform("s", lambda x, i: x + F.when(i == 0, 0.1).otherwise(0.0)))
    return p.select("vec_id", arrays.argmax(F.col("p")).alias("best"), _r(F.array_max("p")).alias("p"), arrays.argmax(F.col("v")).alias("raw_best"))


@query("""
select event_id, round(case when lo - hi < -36 then hi else hi + ln(1 + exp(lo - hi)) end, 6) as log_add, round_even(value * 10, 0) / 10 as half_even,
  floor(value * 100 + 0.5) / 100 as half_up, least(8, greatest(1, event_id % 12)) as threads, case when event_id % 5 = 0 then -1 else value end as finite
from (select *, greatest(-value, -50 + value * 0.5) as hi, least(-value, -50 + value * 0.5) as lo from events)""")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.select(
        "event_id", _r(mathx.log_add(-F.col("value"), -50 + F.col("value") * 0.5)).alias("log_add"), (F.bround(F.col("value") * 10) / 10).alias("half_even"),
        mathx.round_half_up(F.col("value")).alias("half_up"), mathx.clamp(F.col("event_id") % 12, 1, 8).alias("threads"), mathx.finite_or(odd, F.lit(-1.0)).alias("finite"),
    )


@query("""
select hz, round(1127.0e0 * ln(1 + hz / 700.0e0), 6) as htk, round(700.0e0 * (exp(1127.0e0 * ln(1 + hz / 700.0e0) / 1127.0e0) - 1), 4) as htk_back,
  round(case when hz < 1000 then hz * 3 / 200.0e0 else 15 + 27 * ln(greatest(hz, 1) / 1000.0e0) / ln(6.4e0) end, 6) as slaney,
  round(case when hz < 20 or hz > 7800 then hz when hz < 110 then 20 + (hz - 20) * ((110 / 1.1e0 - 20) / 90) when hz < 7500 then hz / 1.1e0 else 7800 + (hz - 7800) * ((7800 - 7500 / 1.1e0) / 300) end, 4) as warped,
  case when (hz - 4000) % 46 < 0 then (hz - 4000) % 46 + 46 else (hz - 4000) % 46 end as m, cast(power(2, ceil(log2(greatest(hz, 1)))) as bigint) as pow2
from (select unnest(range(0, 8001, 50)) as hz)""")
def mel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.range(0, 8001, 50).withColumnRenamed("id", "hz")
    hz = F.col("hz").cast("double")
    return r.select(
        "hz", _r(mathx.mel_htk(hz)).alias("htk"), _r(mathx.hz_htk(mathx.mel_htk(hz)), 4).alias("htk_back"), _r(mathx.mel_slaney(hz)).alias("slaney"),
        _r(mathx.vtln_warp(hz, 100.0, 7500.0, 20.0, 7800.0, 1.1), 4).alias("warped"), F.pmod(F.col("hz") - 4000, F.lit(46)).alias("m"), mathx.power_of_two(F.col("hz")).alias("pow2"),
    )


@query("""
select i, case when ((i % 46) + 46) % 46 < 23 then ((i % 46) + 46) % 46 else 45 - ((i % 46) + 46) % 46 end as at_ from (select unnest(range(-200, 201)) as i)""")
def reflect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-200, 201).select(F.col("id").alias("i"), mathx.reflect(F.col("id"), F.lit(23)).alias("at_"))


@query("""
with i as (select unnest(range(400)) as i), t as (select i, 2 * pi() * i / 399.0e0 as a, 2 * pi() * i / 400.0e0 as b from i)
select cast(i as integer) as i, round(0.5 - 0.5 * cos(a), 9) as hanning, round(0.54 - 0.46 * cos(a), 9) as hamming, round(0.42 - 0.5 * cos(a) + 0.08 * cos(2 * a), 9) + 0.0e0 as blackman, round(0.5 - 0.5 * cos(b), 9) as hann,
  round(power(0.5 - 0.5 * cos(a), 0.85), 9) as povey, round(sin(a / 2), 9) as sine, 1.0e0 as rectangular from t""")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("hanning", "hamming", "blackman", "hann", "povey", "sine", "rectangular")
    one = spark.range(1).select(F.arrays_zip(*[arrays.window_function(k, 400).alias(k) for k in kinds]).alias("w"))
    return one.select(F.posexplode("w").alias("i", "w")).select("i", *[_r(F.col(f"w.{k}"), 9).alias(k) for k in kinds])


@query("""
with k as (select unnest(range(13)) as k), j as (select unnest(range(23)) as j)
select cast(k as integer) as k, cast(j as integer) as j, round(case when k = 0 then sqrt(1 / 23.0e0) else sqrt(2 / 23.0e0) * cos(pi() / 23 * (j + 0.5e0) * k) end, 6) + 0.0e0 as dct, round(1 + 11 * sin(pi() * k / 22), 6) as lifter from k, j""")
def dct_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.range(1).select(F.posexplode(F.arrays_zip(arrays.dct(13, 23).alias("row"), arrays.lifter(13, 22.0).alias("l"))).alias("k", "x"))
    return m.select("k", F.col("x.l").alias("l"), F.posexplode("x.row").alias("j", "v")).select("k", "j", _r("v").alias("dct"), _r("l").alias("lifter"))


@query("""
select stage, cast(sum(ms) as bigint) as ms, sum(ms) / 1000.0e0 as seconds, case when sum(ms) >= 60000 then cast(sum(ms) // 60000 as varchar) || 'm' else cast(sum(ms) // 1000 as varchar) || 's' end as shown
from (select event_type as stage, greatest(0, cast(trunc(value * 100) as bigint)) as ms from events) group by stage""")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum(F.greatest(F.lit(0).cast("long"), (F.col("value") * 100).cast("long"))).alias("ms"))
    whole = lambda d: F.floor(F.col("ms") / d).cast("string")
    return g.select("stage", "ms", (F.col("ms") / 1000).alias("seconds"), F.when(F.col("ms") >= 60000, F.concat(whole(60000), F.lit("m"))).otherwise(F.concat(whole(1000), F.lit("s"))).alias("shown"))


@query("""
select item_id, string_agg(label || ' ' || cast(v as varchar), ', ' order by place) as line
from (select user_id % 16 as item_id, 1 as place, 'click' as label, count(*) filter (event_type = 'click') as v from events group by all
  union all select user_id % 16, 2, 'error', count(*) filter (event_type = 'error' and value > 150) from events group by all
  union all select user_id % 16, 3, 'view', count(*) filter (event_type = 'view') from events group by all) where v > 0 group by item_id""")
def timing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures above 0 in a fixed order, in one line."""
    t = F.col("event_type")
    g = fx.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 16).alias("item_id")).agg(F.count_if(t == "click").alias("click"), F.count_if((t == "error") & (F.col("value") > 150)).alias("error"), F.count_if(t == "view").alias("view"))
    parts = F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(c + " "), F.col(c).cast("string"))) for c in ("click", "error", "view")])
    return g.select("item_id", F.array_join(parts, ", ").alias("line")).where("line <> ''")
