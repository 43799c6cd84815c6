"""Queries on segmentation: voice activity, masks, chunks, windows, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.operators import segment
from talkspan.plans import fixtures as fx
from talkspan.plans.fixtures import sql
from talkspan.plans.intervals import _ATTRIBUTED, _SEGMENTS, attributed
from talkspan.plans.registry import query


def _vad_sql(tag: str, thr: float, speech: int) -> str:
    return f"""
h{tag} as (select item_id, frame_no, sum(fresh) over (partition by item_id order by frame_no) as isl from
  (select *, case when lag(frame_no) over o is null or frame_no - lag(frame_no) over o > 3 then 1 else 0 end as fresh
   from fx_frames where prob >= {thr} window o as (partition by item_id order by frame_no))),
r{tag} as (select item_id, isl, min(frame_no) as a, max(frame_no) + 1 as b from h{tag} group by all),
s{tag} as (select item_id, isl, a, case when n - b < 3 then n else b end as b, n from r{tag} join n using (item_id)),
p{tag} as (select item_id, isl, greatest(0, a * 512 - 16000) as s, least(n * 512, b * 512 + 16000) as e from s{tag} where b - a >= {speech}),
q{tag} as (select *, sum(fresh) over (partition by item_id order by isl) as part from
  (select *, case when lag(e) over o is null or s - lag(e) over o >= 4000 then 1 else 0 end as fresh from p{tag} window o as (partition by item_id order by isl))),
v{tag} as (select item_id, min_by(s, isl) as s, max_by(e, isl) as e from q{tag} group by item_id, part)"""


_N = "n as (select item_id, count(*) as n from fx_frames group by all)"


@query(sql(f'with {_N}, {_vad_sql("a", 0.2, 7)} select item_id, s as start, e as "end" from va', "fx_frames"))
def vad_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.hysteresis(fx.frames(spark, sf_dir), "item_id", 0.2)


@query(sql(f'with {_N}, {_vad_sql("a", 0.9, 7)}, {_vad_sql("b", 0.6, 4)}, ' + """
u as (select *, 1 as attempt from va union all select *, 2 from vb union all select item_id, 0, n * 512, 3 from n)
select item_id, s as start, e as "end", attempt from u qualify attempt = min(attempt) over (partition by item_id)""", "fx_frames"))
def vad_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_retry(fx.frames(spark, sf_dir), "item_id", (0.9, 250), (0.6, 150))


@query(sql("""
with m as (select item_id, max(abs(prob)) as top from fx_frames group by all)
select item_id, frame_no, round(case when top > 1e-6 and top < 0.071 then prob * (0.071 / top) else prob end, 9) as boosted from fx_frames join m using (item_id)""", "fx_frames"))
def vad_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales quiet items up to a peak of 0.071."""
    top = F.max(F.abs("prob")).over(Window.partitionBy("item_id"))
    rows = fx.frames(spark, sf_dir).withColumn("top", top)
    return rows.select("item_id", "frame_no", F.round(F.when((F.col("top") > 1e-6) & (F.col("top") < 0.071), F.col("prob") * (0.071 / F.col("top"))).otherwise(F.col("prob")), 9).alias("boosted"))


@query(sql("""
with o as (select item_id, frame_no, frame_no - row_number() over (partition by item_id order by frame_no) as run from fx_frames where prob >= 0.4),
r as (select item_id, min(frame_no) * 50 as s, (max(frame_no) + 1) * 50 as e from o group by item_id, run having count(*) * 50 >= 250),
q as (select *, sum(fresh) over (partition by item_id order by s) as part from
  (select *, case when lag(e) over w is null or s - lag(e) over w >= 100 then 1 else 0 end as fresh from r window w as (partition by item_id order by s)))
select item_id, min(s) as start_ms, max(e) as end_ms from q group by item_id, part""", "fx_frames"))
def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.mask_regions(fx.frames(spark, sf_dir), "item_id", F.col("prob") >= 0.4, 50)


@query(sql("""
select item_id, chunk * 5 + frame as out_frame, sum(case when s0 + s1 + s2 > 0 then 1 else 0 end) as speech, count(*) as total,
  avg(case when s0 + s1 + s2 > 0 then 1.0e0 else 0.0e0 end) > 0.5 as voiced from fx_mask group by all""", "fx_mask"))
def frame_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of overlapping chunks (a chunk begins five frames after the one before)."""
    active = (F.col("s0") + F.col("s1") + F.col("s2") > 0).cast("int")
    g = fx.mask(spark, sf_dir).groupBy("item_id", (F.col("chunk") * 5 + F.col("frame")).alias("out_frame"))
    return g.agg(F.sum(active).alias("speech"), F.count("*").alias("total"), (F.avg(active) > 0.5).alias("voiced"))


@query(sql("select item_id, chunk * 5 + frame as out_frame, cast(round_even(avg(s0 + s1 + s2), 0) as bigint) as speakers from fx_mask group by all", "fx_mask"))
def overlap_count_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.mask(spark, sf_dir).groupBy("item_id", (F.col("chunk") * 5 + F.col("frame")).alias("out_frame"))
    return g.agg(F.bround(F.avg(F.col("s0") + F.col("s1") + F.col("s2"))).cast("long").alias("speakers"))


@query(sql("""select item_id, chunk, frame, case when s0 + s1 + s2 >= 2 then 0 else s0 end as s0, case when s0 + s1 + s2 >= 2 then 0 else s1 end as s1,
  case when s0 + s1 + s2 >= 2 then 0 else s2 end as s2 from fx_mask""", "fx_mask"))
def non_overlap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.mask(spark, sf_dir)
    crowded = F.col("s0") + F.col("s1") + F.col("s2") >= 2
    return m.select("item_id", "chunk", "frame", *[F.when(crowded, 0).otherwise(F.col(c)).alias(c) for c in ("s0", "s1", "s2")])


@query(sql("""
select item_id, chunk, sum(s0) as n0, sum(s1) as n1, sum(s2) as n2,
  sum(case when s0 + s1 + s2 = 1 then s0 else 0 end) >= 0.2 * count(*) as train from fx_mask group by all""", "fx_mask"))
def chunk_train_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active frames of each local speaker, and whether the first is alone in a fifth of the chunk."""
    alone = F.when(F.col("s0") + F.col("s1") + F.col("s2") == 1, F.col("s0")).otherwise(0)
    g = fx.mask(spark, sf_dir).groupBy("item_id", "chunk")
    return g.agg(F.sum("s0").alias("n0"), F.sum("s1").alias("n1"), F.sum("s2").alias("n2"), (F.sum(alone) >= 0.2 * F.count("*")).alias("train"))


@query(sql("""
with l as (select item_id, chunk, frame, chunk * 5 + frame as out_frame, (chunk + sp) % 4 as cluster, a from fx_mask, lateral (select 0 as sp, s0 as a union all select 1, s1 union all select 2, s2)),
m as (select item_id, chunk, out_frame, cluster, max(a) as a from l group by all),
s as (select item_id, out_frame, cluster, sum(a) as act from m group by all),
c as (select item_id, chunk * 5 + frame as out_frame, round_even(avg(s0 + s1 + s2), 0) as n from fx_mask group by all),
t as (select s.item_id, s.out_frame, cluster from s join c on s.item_id = c.item_id and s.out_frame = c.out_frame where n >= 1 and act > 0
  qualify row_number() over (partition by s.item_id, s.out_frame order by act desc, cluster) = 1),
r as (select *, out_frame - row_number() over (partition by item_id, cluster order by out_frame) as run from t)
select item_id, cluster, min(out_frame) as first_frame, max(out_frame) + 1 as end_frame from r group by item_id, cluster, run""", "fx_mask"))
def reconstruct_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each cluster where it is the most active: the greatest of its local speakers per chunk, summed over
    chunks; one cluster per frame, and only where the rounded speaker count is 1 or more."""
    m = fx.mask(spark, sf_dir).withColumn("out_frame", F.col("chunk") * 5 + F.col("frame"))
    local = F.explode(F.array(*[F.struct(((F.col("chunk") + i) % 4).alias("cluster"), F.col(f"s{i}").alias("a")) for i in range(3)]))
    act = m.select("item_id", "chunk", "out_frame", local.alias("x")).groupBy("item_id", "chunk", "out_frame", "x.cluster").agg(F.max("x.a").alias("a"))
    act = act.groupBy("item_id", "out_frame", "cluster").agg(F.sum("a").alias("act")).where("act > 0")
    count = m.groupBy("item_id", "out_frame").agg(F.bround(F.avg(F.col("s0") + F.col("s1") + F.col("s2"))).alias("n")).where("n >= 1")
    top = F.row_number().over(Window.partitionBy("item_id", "out_frame").orderBy(F.desc("act"), "cluster"))
    best = act.join(count, ["item_id", "out_frame"]).withColumn("r", top).where("r = 1")
    run = F.col("out_frame") - F.row_number().over(Window.partitionBy("item_id", "cluster").orderBy("out_frame"))
    return best.withColumn("run", run).groupBy("item_id", "cluster", "run").agg(F.min("out_frame").alias("first_frame"), (F.max("out_frame") + 1).alias("end_frame")).drop("run")


@query(sql("""
with l as (select item_id, (chunk + sp) % 4 as cluster, chunk, frame, sp from fx_mask, lateral (select 0 as sp, s0 as a union all select 1, s1 union all select 2, s2) where a > 0),
f as (select item_id, cluster, min(struct_pack(c := chunk, f := frame, s := sp)) as first from l group by all)
select item_id, cluster, row_number() over (partition by item_id order by first) - 1 as canonical from f""", "fx_mask"))
def cluster_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters numbered by their first active chunk, frame and local speaker."""
    local = F.explode(F.array(*[F.struct(F.lit(i).alias("sp"), F.col(f"s{i}").alias("a")) for i in range(3)]))
    rows = fx.mask(spark, sf_dir).select("item_id", "chunk", "frame", local.alias("x")).where("x.a > 0")
    first = rows.groupBy("item_id", ((F.col("chunk") + F.col("x.sp")) % 4).alias("cluster")).agg(F.min(F.struct("chunk", "frame", "x.sp")).alias("first"))
    return first.select("item_id", "cluster", (F.row_number().over(Window.partitionBy("item_id").orderBy("first")) - 1).alias("canonical"))


@query(sql(f"""with {_ATTRIBUTED},
a as (select w.conv_id, w.pos, w.end_ms, speaker, lead(w.start_ms) over o as ns, lead(speaker) over o as nsp, count(*) over (partition by w.conv_id) as n
  from fx_words w join who on w.conv_id = who.conv_id and w.pos = who.pos window o as (partition by w.conv_id order by w.pos))
select conv_id, pos, cast(case when ns is null then 1000 when nsp <> speaker then greatest(1000, ns - end_ms) else greatest(0, ns - end_ms) end as bigint) as pause_ms
from a where n >= 2""", "fx_words", "fx_conv_turns"))
def pause_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.pause_hints(attributed(spark, sf_dir, "start_ms", "end_ms"), "conv_id")


_FOLDED = sql(f"""with {_SEGMENTS},
sm as materialized (select conv_id, pos, tok, start_ms, end_ms, speaker, row_number() over (partition by conv_id order by pos) as i from sw),
fold as (select conv_id, i, speaker, 1 as n, 0 as seg_no, false as full_ from sm where i = 1
  union all select w.conv_id, w.i, w.speaker, case when x.new then 1 else f.n + 1 end, f.seg_no + cast(x.new as integer),
    case when x.new then false else f.n + 1 >= 34 or (f.n + 1 >= 10 and regexp_matches(w.tok, '[.?!:]$')) end
  from fold f join sm w on w.conv_id = f.conv_id and w.i = f.i + 1, lateral (select f.full_ or w.speaker is distinct from f.speaker as new) x)
select conv_id, seg_no, any_value(fold.speaker) as speaker, count(*) as n_words, min_by(start_ms, i) as start_ms, max(end_ms) as end_ms, string_agg(tok, ' ' order by i) as text
from fold join sm using (conv_id, i) group by conv_id, seg_no""", "fx_words", "fx_conv_turns")


@query(_FOLDED.replace("with ", "with recursive ", 1))
def writer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentence_groups(attributed(spark, sf_dir, "tok", "start_ms", "end_ms"), "conv_id")


@query(sql("""
with c as (select item_id, seg_no, start * 40 as s, end_ * 40 as e, unnest(range(start * 40, end_ * 40, 480000)) as c, unnest(range(len(range(start * 40, end_ * 40, 480000)))) as chunk from fx_segments where end_ > start)
select item_id, seg_no, cast(chunk as integer) as chunk, case when chunk = 0 then c else greatest(s, c - 48000) end as start, least(e, c + 480000) as "end" from c""", "fx_segments"))
def asr_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.segments(spark, sf_dir).select("item_id", "seg_no", (F.col("start") * 40).alias("start"), (F.col("end") * 40).alias("end"))
    return segment.overlapped_chunks(s, ["item_id", "seg_no"], 480_000, 48_000)


_DOC_WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')"


@query(f"""
with n as (select doc_id, cast(len({_DOC_WORDS}) as bigint) as n from documents),
c as (select doc_id, n, 0 as chunk, cast(0 as bigint) as start, n as e from n where n between 1 and 56
  union all select doc_id, n, 0, 0, (n + 17) // 2 from n where n between 57 and 95
  union all select doc_id, n, 1, (n + 17) // 2 - 16, n from n where n between 57 and 95
  union all select doc_id, n, unnest(range((n - 56 + 39) // 40 + 1)), unnest(range((n - 56 + 39) // 40 + 1)) * 40, null from n where n >= 96)
select doc_id, cast(chunk as integer) as chunk, start, coalesce(e, least(start + 56, n)) as "end" from c""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"))
    return segment.token_chunks(d, ["doc_id"], F.col("n"))


@query("""
with n as (select doc_id, n_chars * 100 as n from documents)
select doc_id, cast(k as integer) as chunk, k * 80000 as start from (select doc_id, unnest(range(greatest(0, floor((n - 160000) / 80000) + 1)::bigint + 1)) as k from n)""")
def fixed_hop_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 100).alias("n"))
    return segment.hop_starts(d, ["doc_id"], F.col("n"))


@query("""
with n as (select doc_id, n_chars as n from documents where n_chars > 0),
s as (select doc_id, n, unnest(case when n <= 150 then [0] else list_distinct(range(0, n - 149, 60) || [n - 150]) end) as start from n)
select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as win, start, least(n, start + 150) as "end" from s""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return segment.sliding_windows(d, ["doc_id"], F.col("n"))


@query(f"""
with w as (select doc_id, n_chars, {_DOC_WORDS} as w from documents),
n as (select *, len(w) as n, case when len(w) > 40 then 32 else greatest(len(w), 1) end as per from w where len(w) > 0),
p as (select *, unnest(range((n + per - 1) // per)) as part from n)
select doc_id, cast(part as integer) as part, array_to_string(w[part * per + 1 : part * per + per], ' ') as text, cast(len(w[part * per + 1 : part * per + per]) as integer) as n_words,
  cast(floor(n_chars * 50 * least(part * per, n) / n) as bigint) as start_ms, cast(floor(n_chars * 50 * least((part + 1) * per, n) / n) as bigint) as end_ms from p""")
def rechunk_32_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    return segment.rechunk(d, ["doc_id"], words, F.lit(0).cast("long"), F.col("n_chars") * 50)


_TOKENS = """
tk as (select conv_id, pos * 2 + half as pos, case half when 0 then '▁' || tok[1:2] else tok[3:] end as piece, start_ms + half * 60 as at_ms, ln(prob * 0.9 + 0.05) as lp
  from fx_words, (select unnest([0, 1]) as half) where half = 0 or length(tok) > 2)"""


@query(sql(f"with {_TOKENS}," + """
s as (select *, count(*) over (partition by conv_id) as n, max(at_ms) over (partition by conv_id) as hi, min(at_ms) over (partition by conv_id) as lo,
  sum(case when piece[1] = '▁' then 1 else 0 end) over (partition by conv_id order by pos) as word from tk),
g as (select conv_id, word, trim(replace(string_agg(piece, '' order by pos), '▁', ' ')) as text, min_by(at_ms, pos) as start_ms, max_by(at_ms, pos) as last_ms,
  any_value(case when n > 1 then (hi - lo) / (n - 1) else 80.0 end) as step, avg(exp(lp)) as prob from s group by conv_id, word),
e as (select *, least(last_ms + step, lead(start_ms) over (partition by conv_id order by word), start_ms + 400) as e from g)
select conv_id, word, text, start_ms, cast(floor(case when e <= start_ms then start_ms + 10 else e end) as bigint) as end_ms, round(prob, 6) as prob from e where text <> ''""", "fx_words"))
def words_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of made-up tokens: two characters, and the rest."""
    w = fx.words(spark, sf_dir)
    two = F.array(F.struct(F.lit(0).alias("half"), F.concat(F.lit("▁"), F.substring("tok", 1, 2)).alias("piece")), F.struct(F.lit(1).alias("half"), F.expr("substring(tok, 3)").alias("piece")))
    t = w.select("conv_id", "pos", "start_ms", "prob", F.explode(two).alias("x")).where("x.half = 0 or x.piece <> ''")
    t = t.select("conv_id", (F.col("pos") * 2 + F.col("x.half")).alias("pos"), "x.piece", (F.col("start_ms") + F.col("x.half") * 60).alias("at_ms"), F.log(F.col("prob") * 0.9 + 0.05).alias("lp"))
    return segment.words_of_tokens(t, "conv_id").withColumn("prob", F.round("prob", 6))


@query(sql("""
select item_id, turn_no, case when n < 400 then 0 else 1 + (n - 400) // 160 end as snipped, (n + 80) // 160 as whole, turn_no * 160 as first_snipped, turn_no * 160 - 120 as first_whole
from (select item_id, turn_no, (end_ms - start_ms) * 16 as n from fx_turns)""", "fx_turns"))
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir).withColumn("n", (F.col("end_ms") - F.col("start_ms")) * 16)
    count = lambda snip: segment.frame_count(F.col("n"), 400, 160, snip)
    first = lambda snip: segment.first_sample(F.col("turn_no"), 400, 160, snip)
    return t.select("item_id", "turn_no", count(True).alias("snipped"), count(False).alias("whole"), first(True).alias("first_snipped"), first(False).alias("first_whole"))


@query(sql("""
with c as (select item_id, turn_no, speaker, (turn_no - 1) // 40 as chunk, row_number() over (partition by item_id, (turn_no - 1) // 40 order by turn_no) as own from fx_turns),
n as (select item_id, chunk, count(*) as n from c group by all),
o as (select item_id, chunk, coalesce(sum(n) over (partition by item_id order by chunk rows between unbounded preceding and 1 preceding), 0) as before from n)
select c.item_id, cast(own + before as bigint) as turn_no, c.chunk, speaker from c join o on c.item_id = o.item_id and c.chunk = o.chunk""", "fx_turns"))
def append_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered within chunks of forty, appended again: each chunk's numbers go on after those before it."""
    t = fx.turns(spark, sf_dir).withColumn("chunk", F.floor((F.col("turn_no") - 1) / 40))
    own = F.row_number().over(Window.partitionBy("item_id", "chunk").orderBy("turn_no"))
    parts = t.select("item_id", "chunk", "speaker", own.cast("long").alias("own"))
    sizes = parts.groupBy("item_id", "chunk").agg(F.max("own").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("item_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(sizes.select("item_id", "chunk", before.alias("before")), ["item_id", "chunk"]).select("item_id", (F.col("own") + F.col("before")).alias("turn_no"), "chunk", "speaker")


@query(sql("""
with g as (select item_id, ts, event_id, value from (select user_id % 16 as item_id, * from events)),
a as (select *, lag(epoch_us(ts)) over (partition by item_id order by ts, event_id) as p from g),
b as (select *, sum(case when p is null or epoch_us(ts) - p > 1800000000 then 1 else 0 end) over (partition by item_id order by ts, event_id) as s from a)
select item_id, min(epoch_us(ts)) // 1000 as first_ms, max(epoch_us(ts)) // 1000 as last_ms, count(*) as n from b group by item_id, s""", "fx_turns"))
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events not more than half an hour apart: the batch twin of the stream."""
    e = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("item_id", F.session_window("ts", "30 minutes").alias("s"))
    return g.agg(F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"), F.count("*").alias("n")).drop("s")
