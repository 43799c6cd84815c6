"""Queries on intervals: merging, joining, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.operators import joins, merge
from talkspan.plans import fixtures as fx
from talkspan.plans.fixtures import sql
from talkspan.plans.registry import query

ITEM = ["item_id"]


def _merge_sql(order: str, apart: str, start: str = "min(start_ms)") -> str:
    return sql(
        f"""
with a as (select *, lag(speaker) over (partition by item_id order by {order}) as ps,
             row_number() over (partition by item_id order by {order}) as rn from fx_turns),
b as (select *, sum(case when ps is null or ps <> speaker then 1 else 0 end) over (partition by item_id order by rn) as run from a),
c as (select *, max(end_ms) over (partition by item_id, run order by rn rows between unbounded preceding and 1 preceding) as reach from b),
d as (select *, sum(case when reach is null or {apart} then 1 else 0 end) over (partition by item_id, run order by rn) as isl from c)
select item_id, {start} as start_ms, max(end_ms) as end_ms, any_value(speaker) as speaker, count(*) as n from d group by item_id, run, isl""",
        "fx_turns",
    )


@query(_merge_sql("start_ms, speaker, turn_no", "start_ms - reach > 300"))
def turn_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.gap_merge(fx.turns(spark, sf_dir), ITEM, 300)


@query(_merge_sql("start_ms, speaker, turn_no", "start_ms - reach > 500"))
def turn_gap_merge_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.gap_merge(fx.turns(spark, sf_dir), ITEM, 500)


@query(_merge_sql("turn_no", "start_ms - reach > 0", "min_by(start_ms, turn_no)"))
def turn_gap_merge_nosort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.gap_merge(fx.turns(spark, sf_dir), ITEM, 0, sort=False)


@query(_merge_sql("turn_no", "start_ms - reach > 4000", "min_by(start_ms, turn_no)"))
def turn_gap_merge_4s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.gap_merge(fx.turns(spark, sf_dir), ITEM, 4000, sort=False)


@query(_merge_sql("turn_no", "false", "min_by(start_ms, turn_no)"))
def turn_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.gap_merge(fx.turns(spark, sf_dir), ITEM, None, sort=False)


@query(sql("""
with a as (select *, row_number() over (partition by item_id, speaker order by start_ms, turn_no) as rn from fx_turns),
c as (select *, max(end_ms) over (partition by item_id, speaker order by rn rows between unbounded preceding and 1 preceding) as reach from a),
d as (select *, sum(case when reach is null or start_ms - reach >= 2000 then 1 else 0 end) over (partition by item_id, speaker order by rn) as isl from c)
select item_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from d group by item_id, speaker, isl""", "fx_turns"))
def virtual_turns_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.virtual_turns(fx.turns(spark, sf_dir), ITEM)


@query(sql("""
with a as (select *, end_ms - start_ms < 1500 as short, row_number() over (partition by item_id order by start_ms, turn_no) as rn from fx_turns),
b as (select *, rn - row_number() over (partition by item_id, short order by rn) as run from a),
c as (select *, count(*) over (partition by item_id, short, run) as size from b),
z as (select * from c where short and size >= 3),
h as (select item_id, run, speaker, sum(end_ms - start_ms) as held from z group by all),
t as (select item_id, run, speaker from h qualify row_number() over (partition by item_id, run order by held desc, speaker) = 1),
m as (select item_id, run, min_by(start_ms, rn) as start_ms, max_by(end_ms, rn) as end_ms, count(*) as n from z group by all)
select item_id, start_ms, end_ms, speaker, n from m join t using (item_id, run)
union all select item_id, start_ms, end_ms, speaker, 1 from c where not (short and size >= 3)""", "fx_turns"))
def fragment_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fragment_zones(fx.turns(spark, sf_dir), ITEM, short_ms=1500)


@query(sql("""
select item_id, turn_no, case when pe > start_ms then (pe + start_ms) // 2 else start_ms end as start_ms,
  case when end_ms > ns then (end_ms + ns) // 2 else end_ms end as end_ms, speaker
from (select *, lead(start_ms) over o as ns, lag(end_ms) over o as pe from fx_turns window o as (partition by item_id order by start_ms, turn_no))""", "fx_turns"))
def midpoint_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.midpoint_cut(fx.turns(spark, sf_dir), ITEM)


@query(sql("""
with a as (select *, lag(speaker) over (partition by item_id order by turn_no) as ps from fx_turns),
b as (select *, sum(case when ps is null or ps <> speaker then 1 else 0 end) over (partition by item_id order by turn_no) as block from a)
select item_id, turn_no, speaker, block, min(turn_no) over (partition by item_id, block) as block_first,
  max(turn_no) over (partition by item_id, block) as block_last from b""", "fx_turns"))
def speaker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.blocks(fx.turns(spark, sf_dir), ITEM)
    return rows.select("item_id", "turn_no", "speaker", "block", "block_first", "block_last")


@query(sql("""
with h as (select item_id, speaker, sum(end_ms - start_ms) as held_ms from fx_turns group by all),
r as (select *, row_number() over (partition by item_id order by held_ms desc, speaker) - 1 as rank from h)
select t.item_id, turn_no, rank as speaker, held_ms from fx_turns t join r on t.item_id = r.item_id and t.speaker = r.speaker""", "fx_turns"))
def speaker_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir)
    return t.join(merge.rank_speakers(t, ITEM), ["item_id", "speaker"]).select("item_id", "turn_no", F.col("rank").alias("speaker"), "held_ms")


@query(sql("""
with f as (select item_id, speaker, min(turn_no) as first from fx_turns group by all),
s as (select *, row_number() over (partition by item_id order by first) - 1 as seen from f)
select t.item_id, turn_no, seen from fx_turns t join s on t.item_id = s.item_id and t.speaker = s.speaker""", "fx_turns"))
def relabel_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir)
    return t.join(merge.first_seen(t, ITEM, "speaker", ["turn_no"]), ["item_id", "speaker"]).select("item_id", "turn_no", "seen")


@query(sql("""
with a as (select *, lag(label) over (partition by item_id order by win_no) as pl from fx_windows),
b as (select *, sum(case when pl is null or pl <> label then 1 else 0 end) over (partition by item_id order by win_no) as run from a),
c as (select *, max(end_ms) over (partition by item_id, run order by win_no rows between unbounded preceding and 1 preceding) as reach from b),
d as (select *, sum(case when reach is null or start_ms - reach >= 10 then 1 else 0 end) over (partition by item_id, run order by win_no) as isl from c)
select item_id, min(start_ms) as start_ms, max(end_ms) as end_ms, any_value(label) as speaker, count(*) as n from d group by item_id, run, isl""", "fx_windows"))
def labels_to_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.windows(spark, sf_dir).select("item_id", "win_no", "start_ms", "end_ms", F.col("label").alias("speaker"))
    return merge.gap_merge(w, ITEM, 10, ordinal="win_no", sort=False, strict=True)


_ATTRIBUTED = """
w as (select conv_id, pos, least(s, e) as ws, case when greatest(s, e) <= least(s, e) then least(s, e) + 400 else least(greatest(s, e), least(s, e) + 400) end as we
  from (select conv_id, pos, start_ms as s, case when end_ms = 0 then start_ms else end_ms end as e from fx_words)),
ov as (select w.conv_id, w.pos, t.speaker from w join fx_conv_turns t on w.conv_id = t.conv_id and ws < t.end_ms and t.start_ms < we
  qualify row_number() over (partition by w.conv_id, w.pos order by least(we, t.end_ms) - greatest(ws, t.start_ms) desc, abs(t.start_ms + t.end_ms - ws - we), t.turn) = 1),
un as (select * from w anti join ov on w.conv_id = ov.conv_id and w.pos = ov.pos),
pv as (select un.conv_id, un.pos, ws + we - 2 * t.end_ms as d, speaker from un join fx_conv_turns t on un.conv_id = t.conv_id and 2 * t.end_ms <= ws + we
  qualify row_number() over (partition by un.conv_id, un.pos order by t.end_ms desc, turn) = 1),
nx as (select un.conv_id, un.pos, 2 * t.start_ms - ws - we as d, speaker from un join fx_conv_turns t on un.conv_id = t.conv_id and 2 * t.start_ms >= ws + we
  qualify row_number() over (partition by un.conv_id, un.pos order by t.start_ms, turn) = 1),
who as (select conv_id, pos, speaker, 'overlap' as how from ov
  union all select un.conv_id, un.pos, cast(coalesce(case when nx.d is null or pv.d <= nx.d then pv.speaker end, nx.speaker, 0) as integer),
    case when pv.d is null and nx.d is null then 'none' else 'near' end
  from un left join pv on un.conv_id = pv.conv_id and un.pos = pv.pos left join nx on un.conv_id = nx.conv_id and un.pos = nx.pos)"""


def attributed(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return joins.attribute_words(fx.words(spark, sf_dir), fx.conv_turns(spark, sf_dir), "conv_id", keep=keep)


@query(sql(f"with {_ATTRIBUTED} select conv_id, pos, speaker, how from who", "fx_words", "fx_conv_turns"))
def word_speaker_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir)


@query(sql(f"with {_ATTRIBUTED} select conv_id, how, count(*) as n, sum(speaker) as speakers from who where how <> 'overlap' group by all", "fx_words", "fx_conv_turns"))
def nearest_turn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attributed(spark, sf_dir).where("how <> 'overlap'")
    return rows.groupBy("conv_id", "how").agg(F.count("*").alias("n"), F.sum("speaker").alias("speakers"))


def editor_segments(words: DataFrame, key: str, most: int = 32, terminal: str = r"""[.!?:;]["')\]]*$""") -> DataFrame:
    """key, run, part, speaker, start_ms, end_ms, n_words, text: words (key, pos, tok, start_ms, end_ms, speaker) grouped
    until the speaker changes, a word ends a sentence, or `most` words are in; at least 10 ms long."""
    w = Window.partitionBy(key).orderBy("pos")
    cut = F.lag("speaker").over(w).isNull() | (F.lag("speaker").over(w) != F.col("speaker")) | F.lag("tok").over(w).rlike(terminal)
    rows = words.withColumn("_cut", cut.cast("int")).withColumn("run", F.sum("_cut").over(w))
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(key, "run").orderBy("pos")) - 1) / most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ")
    start = F.min_by("start_ms", "pos")
    out = rows.groupBy(key, "run", "part").agg(F.first("speaker").alias("speaker"), start.alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), text.alias("text"))
    return out.withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + 10))


_SEGMENTS = _ATTRIBUTED + """,
sw as (select w.conv_id, w.pos, w.tok, w.start_ms, w.end_ms, who.speaker from fx_words w join who on w.conv_id = who.conv_id and w.pos = who.pos),
sc as (select *, lag(speaker) over o as ps, lag(tok) over o as pt from sw window o as (partition by conv_id order by pos)),
sr as (select *, sum(case when ps is null or ps <> speaker or regexp_matches(pt, '[.!?:;]["'')\\]]*$') then 1 else 0 end) over (partition by conv_id order by pos) as run from sc),
sp as (select *, (row_number() over (partition by conv_id, run order by pos) - 1) // 32 as part from sr),
seg as (select conv_id, run, part, any_value(speaker) as speaker, min_by(start_ms, pos) as start_ms, greatest(max(end_ms), min_by(start_ms, pos) + 10) as end_ms,
  count(*) as n_words, string_agg(tok, ' ' order by pos) as text from sp group by conv_id, run, part)"""


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editor_segments(attributed(spark, sf_dir, "tok", "start_ms", "end_ms"), "conv_id")


@query(sql(f"with {_SEGMENTS} select * from seg", "fx_words", "fx_conv_turns"))
def attributed_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to their speakers, then to segments: the flagship query."""
    return transcript(spark, sf_dir)


@query(sql("""
select t.conv_id, t.turn, count(w.pos) as n_words from fx_conv_turns t
left join fx_words w on t.conv_id = w.conv_id and w.start_ms + w.end_ms between 2 * t.start_ms and 2 * t.end_ms group by all""", "fx_words", "fx_conv_turns"))
def words_in_turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.count_inside(fx.conv_turns(spark, sf_dir), fx.words(spark, sf_dir), "conv_id", "turn")


@query(sql("""
with t as (select item_id, turn_no, (start_ms * 7 + 12345) % 500000 as t_ms from fx_turns),
s as (select item_id, turn_no as seg_no, start_ms - 35 as at_ms, start_ms from fx_turns
      qualify row_number() over (partition by item_id, start_ms order by turn_no desc) = 1)
select t.item_id, t.turn_no, cast(coalesce(s.seg_no, 0) as bigint) as seg_no from t asof left join s on t.item_id = s.item_id and t.t_ms >= s.at_ms""", "fx_turns"))
def active_segment_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir)
    times = t.select("item_id", "turn_no", ((F.col("start_ms") * 7 + 12345) % 500000).alias("t_ms"))
    return joins.active_at(times, t.select("item_id", F.col("turn_no").alias("seg_no"), "start_ms"), "item_id", "turn_no")


@query(sql("""
with c as (select item_id, seg_no, start as s, end_ as e, unnest(range(start // 9600000, greatest(start // 9600000, (end_ - 1) // 9600000) + 1)) as chunk from fx_segments where end_ > start)
select item_id, seg_no, chunk, greatest(0, s - chunk * 9600000) as start, least(9600000, e - chunk * 9600000) as "end" from c""", "fx_segments"))
def chunk_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.chunk_intersections(fx.segments(spark, sf_dir), ["item_id", "seg_no"], 9_600_000)


@query(sql("""
with a as (select *, coalesce(sum(end_ - start) over (partition by item_id order by seg_no rows between unbounded preceding and 1 preceding), 0) as pos from fx_segments),
b as (select item_id, seg_no, start + greatest(0, 400000 - pos) as s, least(end_, start + 400000 + 144160 - pos) as e from a)
select item_id, seg_no, cast(s as bigint) as start, cast(e as bigint) as "end" from b where e > s""", "fx_segments"))
def speech_timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.timeline_window(fx.segments(spark, sf_dir), ["item_id"], "seg_no", 400_000, 144_160)


@query(sql("""
select item_id, turn_no, greatest(0, start_ms - 4000) as start_ms, least(end_ms, 900000) as end_ms from fx_turns
where start_ms < 900000 and least(end_ms, 900000) > greatest(0, start_ms - 4000)""", "fx_turns"))
def clip_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir).where("start_ms < 900000")
    start, end = F.greatest(F.lit(0).cast("long"), F.col("start_ms") - 4000), F.least(F.col("end_ms"), F.lit(900000).cast("long"))
    return t.select("item_id", "turn_no", start.alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms")


@query(sql("""
with n as (select item_id, turn_no * 100000 as n from fx_turns qualify row_number() over (partition by item_id order by turn_no desc) = 1),
c as (select s.item_id, greatest(0, start) as start, least(end_, 3000000) as e from fx_segments s where least(end_, 3000000) > greatest(0, start)),
i as (select distinct item_id from fx_segments)
select i.item_id, cast(coalesce(start, 0) as bigint) as start, cast(coalesce(e, 3000000) as bigint) as "end" from i left join c using (item_id)""", "fx_segments"))
def speech_segments_or_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.segments(spark, sf_dir)
    n = F.lit(3_000_000).cast("long")
    c = s.select("item_id", F.greatest(F.lit(0).cast("long"), F.col("start")).alias("start"), F.least("end", n).alias("end")).where("end > start")
    return s.select("item_id").distinct().join(c, "item_id", "left").select("item_id", F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.coalesce("end", n).alias("end"))


@query(sql("""
with a as (select *, lag(speaker) over (partition by item_id order by turn_no) as ps from fx_turns)
select item_id, turn_no, 'speaker' as kind, speaker from a where ps is null or ps <> speaker
union all select item_id, turn_no, 'text', speaker from a""", "fx_turns"))
def speaker_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir)
    prev = F.lag("speaker").over(Window.partitionBy("item_id").orderBy("turn_no"))
    kinds = F.when(prev.isNull() | (prev != F.col("speaker")), F.array(F.lit("speaker"), F.lit("text"))).otherwise(F.array(F.lit("text")))
    return t.withColumn("kinds", kinds).select("item_id", "turn_no", F.explode("kinds").alias("kind"), "speaker")


@query(sql("""
with i as (select i.item_id, i.start_ms, i.end_ms, i.speaker, i.turn_no, lead(start_ms) over (partition by item_id order by turn_no) as nxt from fx_turns i)
select a.item_id, a.turn_no as outer_no, b.turn_no as inner_no, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as shared_ms
from fx_turns a join fx_turns b on a.item_id = b.item_id and a.speaker <> b.speaker and b.start_ms >= a.start_ms and b.start_ms < a.end_ms and b.end_ms <= a.end_ms and a.turn_no <> b.turn_no""", "fx_turns"))
def contained_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that lie inside another speaker's turn."""
    t = fx.turns(spark, sf_dir).select("item_id", "turn_no", "start_ms", "end_ms", "speaker")
    a = joins.bucketed(t, F.col("start_ms"), F.col("end_ms"), 60_000).select("item_id", "_bucket", F.col("turn_no").alias("outer_no"), F.col("start_ms").alias("a0"), F.col("end_ms").alias("a1"), F.col("speaker").alias("sa"))
    b = t.withColumn("_bucket", F.floor(F.col("start_ms") / 60_000))
    pairs = a.join(b, ["item_id", "_bucket"]).where("sa <> speaker and start_ms >= a0 and start_ms < a1 and end_ms <= a1 and outer_no <> turn_no")
    shared = joins.overlap(F.col("a0"), F.col("a1"), F.col("start_ms"), F.col("end_ms"))
    return pairs.select("item_id", "outer_no", F.col("turn_no").alias("inner_no"), shared.alias("shared_ms"))
