"""Queries on vectors, folds over items, and transcripts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.functions import arrays
from talkspan.operators import edits, sequences, signal, vectors
from talkspan.plans import fixtures as fx
from talkspan.plans.fixtures import sql
from talkspan.plans.intervals import _SEGMENTS, transcript
from talkspan.plans.registry import query
from talkspan.plans.texts import PALETTE

ITEM = ["item_id"]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
_CENT = """
d as (select item_id, label, unnest(vector) as x, unnest(range(64)) as dim from fx_windows),
m as (select item_id, label, dim, avg(x) as x, count(*) as n from d group by all),
c as (select item_id, label, list(x order by dim) as v, any_value(n) as n from m group by item_id, label),
u as (select item_id, label, n, list_transform(v, lambda x: x / greatest(1e-12, sqrt(list_sum(list_transform(v, lambda y: y * y))))) as v from c)"""


def unit_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(fx.windows(spark, sf_dir), ["item_id", "label"])
    return c.select("item_id", "label", "n", arrays.l2(F.col("centroid")).alias("centroid"))


@query(sql(f"with {_CENT} select item_id, label, n, list_transform(v, lambda x: round(x, 6) + 0.0e0)[1:8] as head from u", "fx_windows"))
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_centroids(spark, sf_dir).select("item_id", "label", "n", F.slice(F.transform("centroid", lambda x: F.round(x, 6) + 0.0), 1, 8).alias("head"))


@query(sql(f"""with {_CENT},
p as (select w.item_id, w.win_no, u.label, {_DOT.format(a='w.vector', b='u.v')} as cosine from fx_windows w join u on w.item_id = u.item_id)
select item_id, win_no, label, round(cosine, 4) as cosine from p qualify row_number() over (partition by item_id, win_no order by cosine desc, label) = 1""", "fx_windows"))
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest_centroid(fx.windows(spark, sf_dir).select("item_id", "win_no", "vector"), unit_centroids(spark, sf_dir).drop("n"), ITEM, "win_no", "label")
    return near.withColumn("cosine", F.round("cosine", 4))


@query(sql(f"""with {_CENT},
s as (select w.item_id, w.win_no, w.label, u.n, w.vector from fx_windows w join u on w.item_id = u.item_id and w.label = u.label),
p as (select s.item_id, s.win_no, u.label, {_DOT.format(a='s.vector', b='u.v')} as cosine from s join u on s.item_id = u.item_id and u.n >= 4 where s.n < 4),
b as (select item_id, win_no, label from p qualify row_number() over (partition by item_id, win_no order by cosine desc, label) = 1)
select s.item_id, s.win_no, cast(case when s.n >= 4 then s.label else coalesce(b.label, 0) end as integer) as label from s left join b on s.item_id = b.item_id and s.win_no = b.win_no""", "fx_windows"))
def minor_cluster_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.reassign_minor(fx.windows(spark, sf_dir), ITEM, "win_no", "label")


_PAIRS = f"p as (select a.item_id, a.win_no as i, b.win_no as j, {_DOT.format(a='a.vector', b='b.vector')} as cosine from fx_windows a join fx_windows b on a.item_id = b.item_id)"


@query(sql(f"with {_PAIRS} select item_id, i, j, round(cosine, 4) as cosine from p where i < j qualify row_number() over (partition by item_id, i order by round(cosine, 4) desc, j) <= 3", "fx_windows"))
def cosine_affinity_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vectors.affinity(fx.windows(spark, sf_dir), ITEM, "win_no").withColumn("cosine", F.round("cosine", 4))
    best = F.row_number().over(Window.partitionBy("item_id", "i").orderBy(F.desc("cosine"), "j"))
    return pairs.withColumn("r", best).where("r <= 3").drop("r")


@query(sql(f"""with {_PAIRS}, r as (select item_id, i, j, round(cosine, 4) + 0.0e0 as cosine from p)
select item_id, i, j, case when row_number() over (partition by item_id, i order by cosine, j) <= 30 then 0.0e0 else cosine end as cosine from r""", "fx_windows"))
def affinity_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.windows(spark, sf_dir).select("item_id", "win_no", "vector")
    a, b = w.toDF("item_id", "i", "a"), w.toDF("item_id", "j", "b")
    pairs = a.join(b, "item_id").select("item_id", "i", "j", (F.round(arrays.dot(F.col("a"), F.col("b")), 4) + 0.0).alias("cosine"))
    return vectors.prune(pairs, ITEM, 30)


@query("""
select vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) as norm, round(1 - list_sum(list_transform(range(1, 65), lambda i: e[i] * e[65 - i])) / greatest(1e-10, list_sum(list_transform(e, lambda x: x * x))), 5) as reversed_distance,
  round(list_sum(list_transform(range(1, 65), lambda i: (e[i] - e[65 - i]) * (e[i] - e[65 - i]))), 5) as squared, list_position(e, list_max(e)) - 1 as best,
  list_transform(range(1, 4), lambda k: list_position(e, list_reverse_sort(e)[k]) - 1) as top3, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))), 6) as lse
from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("r", F.reverse("e"))
    e, r = F.col("e"), F.col("r")
    return v.select(
        "vec_id", F.round(arrays.norm(e), 5).alias("norm"), F.round(arrays.cosine_distance(e, r), 5).alias("reversed_distance"), F.round(arrays.squared_distance(e, r), 5).alias("squared"),
        arrays.argmax(e).alias("best"), arrays.top_k(e, 3).cast("array<long>").alias("top3"), F.round(arrays.log_sum_exp(e), 6).alias("lse"),
    )


@query()
def spectral_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.clustered(fx.windows(spark, sf_dir), "item_id", "win_no", "spectral")


@query()
def recording_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral clusters, small ones reassigned, close ones joined, the longest first."""
    return vectors.clustered(fx.windows(spark, sf_dir), "item_id", "win_no", "recording")


@query()
def kmeans_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.clustered(fx.windows(spark, sf_dir), "item_id", "win_no", "kmeans")


@query()
def ahc_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.clustered(fx.windows(spark, sf_dir), "item_id", "win_no", "agglomerative")


@query()
def vbx_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.clustered(fx.windows(spark, sf_dir), "item_id", "win_no", "vbx")


@query()
def backend_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that two clusterings of the same windows give, side by side: backend, item_id, start_ms, end_ms, speaker."""
    w = fx.windows(spark, sf_dir)
    times = w.select("item_id", "win_no", "start_ms", "end_ms")
    out = [vectors.clustered(w, "item_id", "win_no", method).withColumn("backend", F.lit(method)) for method in ("recording", "vbx")]
    rows = out[0].unionByName(out[1]).join(times, ["item_id", "win_no"])
    new = F.lag("label").over(Window.partitionBy("backend", "item_id").orderBy("win_no"))
    rows = rows.withColumn("cut", F.coalesce((new != F.col("label")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("cut").over(Window.partitionBy("backend", "item_id").orderBy("win_no")))
    turns = rows.groupBy("backend", "item_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("label").alias("speaker"))
    return turns.drop("run")


def projection(dim: int = 64, out: int = 32) -> vectors.Projection:
    """A fixed stand-in for trained parameters."""
    rng = np.random.RandomState(0)
    lda = np.linalg.qr(rng.normal(size=(dim, out)))[0]
    basis, phi = signal.plda_basis(np.linalg.qr(rng.normal(size=(out, out)))[0] * 2, np.linspace(0.5, 4, out))
    return vectors.Projection(np.zeros(dim), lda, np.zeros(out), np.zeros(out), basis, phi)


@query()
def chunk_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of an item as the local speakers of a chunk, clustered and assigned: some are silent, some speak
    too little alone to train."""
    n = F.col("win_no")
    w = fx.windows(spark, sf_dir).select("item_id", F.floor(n / 3).alias("chunk"), (n % 3).cast("int").alias("speaker"), "vector", ((n * 7) % 10 / 10).alias("alone"), (n % 8 != 7).alias("active"))
    return vectors.chunk_speakers(w, "item_id", projection())


def _joined(source: str, name: str, gap: int) -> str:
    """CTEs that join a speaker's turns of `source` up to `gap` apart, as `name`."""
    return f"""
{name}_a as (select *, lag(speaker) over (partition by item_id order by start_ms, speaker, end_ms) as ps, row_number() over (partition by item_id order by start_ms, speaker, end_ms) as rn from {source}),
{name}_b as (select *, sum(case when ps is null or ps <> speaker then 1 else 0 end) over (partition by item_id order by rn) as run from {name}_a),
{name}_c as (select *, max(end_ms) over (partition by item_id, run order by rn rows between unbounded preceding and 1 preceding) as reach from {name}_b),
{name}_d as (select *, sum(case when reach is null or start_ms - reach > {gap} then 1 else 0 end) over (partition by item_id, run order by rn) as isl from {name}_c),
{name} as (select item_id, min(start_ms) as start_ms, max(end_ms) as end_ms, any_value(speaker) as speaker from {name}_d group by item_id, run, isl)"""


#: Rounds that settle which stretches are held: more than stretches lie in one another.
_ROUNDS = 8
_HELD = ",".join(f"""
st{k + 1} as materialized (select x.item_id, x.speaker, x.isl, case when x.kind <> 0 then x.kind when bool_or(h.kind = 1) then 2 when bool_and(h.kind = 2) then 1 else 0 end as kind
  from st{k} x left join inside p on p.item_id = x.item_id and p.js = x.speaker and p.ji = x.isl left join st{k} h on h.item_id = p.item_id and h.speaker = p.hs and h.isl = p.hi
  group by x.item_id, x.speaker, x.isl, x.kind)""" for k in range(_ROUNDS))  # fmt: skip


@query(sql(f"""with {_joined("fx_turns", "one", 300)},
za as (select *, end_ms - start_ms < 500 as short, row_number() over (partition by item_id order by start_ms) as rn from one),
zb as (select *, rn - row_number() over (partition by item_id, short order by rn) as zone from za),
zc as (select *, count(*) over (partition by item_id, short, zone) as size from zb),
zh as (select item_id, zone, speaker, sum(end_ms - start_ms) as held from zc where short and size >= 3 group by all),
zt as (select item_id, zone, speaker from zh qualify row_number() over (partition by item_id, zone order by held desc, speaker) = 1),
zm as (select item_id, zone, min_by(start_ms, rn) as start_ms, max_by(end_ms, rn) as end_ms from zc where short and size >= 3 group by all),
two as (select item_id, start_ms, end_ms, speaker from zm join zt using (item_id, zone) union all select item_id, start_ms, end_ms, speaker from zc where not (short and size >= 3)),
s1 as (select *, count(*) over (partition by item_id) as n, max(end_ms) over (partition by item_id, speaker order by start_ms rows between unbounded preceding and 1 preceding) as reach from two),
s2 as (select *, sum(case when reach is null or start_ms - reach >= 2000 then 1 else 0 end) over (partition by item_id, speaker order by start_ms) as isl from s1),
v as materialized (select item_id, speaker, isl, min(start_ms) as s, max(end_ms) as e from s2 where n > 2 group by all),
inside as materialized (select i.item_id, i.speaker as hs, i.isl as hi, j.speaker as js, j.isl as ji, i.s as begun from v i join v j on i.item_id = j.item_id and i.s < j.s and j.s < i.e and j.e <= i.e and i.speaker <> j.speaker),
st0 as materialized (select v.item_id, v.speaker, v.isl, case when count(p.hs) = 0 then 1 else 0 end as kind from v left join inside p on p.item_id = v.item_id and p.js = v.speaker and p.ji = v.isl group by all),{_HELD},
held as (select p.item_id, js, ji, min_by(hs, begun) as holder from inside p join st{_ROUNDS} h on h.item_id = p.item_id and h.speaker = hs and h.isl = hi and h.kind = 1
  join st{_ROUNDS} x on x.item_id = p.item_id and x.speaker = js and x.isl = ji and x.kind = 2 group by all),
three as (select s2.item_id, start_ms, end_ms, case when v.e - v.s < 2000 then coalesce(holder, s2.speaker) else s2.speaker end as speaker, n
  from s2 left join v on v.item_id = s2.item_id and v.speaker = s2.speaker and v.isl = s2.isl left join held on held.item_id = s2.item_id and js = s2.speaker and ji = s2.isl),
many as (select * from three where n > 2),{_joined("many", "four", 500)},
all4 as (select * from four union all select item_id, start_ms, end_ms, speaker from three where n <= 2),{_joined("all4", "five", 300)}
select * from five""", "fx_turns"))
def turn_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.clean_turns(fx.turns(spark, sf_dir), "item_id")


@query(sql("""
with cut as (select item_id, turn_no, case when pe > start_ms then (pe + start_ms) // 2 else start_ms end as start_ms, case when end_ms > ns then (end_ms + ns) // 2 else end_ms end as end_ms, speaker
  from (select *, lead(start_ms) over o as ns, lag(end_ms) over o as pe from fx_turns window o as (partition by item_id order by start_ms, turn_no))),
a as (select *, lag(speaker) over (partition by item_id order by turn_no) as ps from cut),
b as (select *, sum(case when ps is null or ps <> speaker then 1 else 0 end) over (partition by item_id order by turn_no) as run from a),
c as (select *, max(end_ms) over (partition by item_id, run order by turn_no rows between unbounded preceding and 1 preceding) as reach from b),
d as (select *, sum(case when reach is null or start_ms - reach > 4000 then 1 else 0 end) over (partition by item_id, run order by turn_no) as isl from c),
j as (select item_id, min_by(start_ms, turn_no) as start_ms, max(end_ms) as end_ms, any_value(speaker) as speaker from d group by item_id, run, isl),
k as (select *, end_ms - start_ms > 780 as stays, lead(speaker) over (partition by item_id order by start_ms) as next_speaker from j),
l as (select *, count(*) filter (stays) over (partition by item_id order by start_ms) as no from k),
f as (select item_id, no, speaker, start_ms, end_ms from l where stays),
g as (select f.item_id, f.no, f.start_ms, f.speaker, greatest(f.end_ms, coalesce(max(l.end_ms), 0)) as end_ms from f left join l on l.item_id = f.item_id and l.no = f.no and not l.stays and l.next_speaker = f.speaker group by f.item_id, f.no, f.start_ms, f.speaker, f.end_ms),
h as (select *, lag(speaker) over (partition by item_id order by no) as ps from g),
i as (select *, sum(case when ps is null or ps <> speaker then 1 else 0 end) over (partition by item_id order by no) as block from h),
m as (select item_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by item_id, block, speaker),
r as (select item_id, speaker, row_number() over (partition by item_id order by sum(end_ms - start_ms) desc, speaker) - 1 as rank from m group by item_id, speaker)
select m.item_id, start_ms, end_ms, rank as speaker from m join r on m.item_id = r.item_id and m.speaker = r.speaker""", "fx_turns"))
def turn_post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.post_process(fx.turns(spark, sf_dir), "item_id")


def overlapping_chunks(words: DataFrame, key: str, size_ms: int, step_ms: int) -> DataFrame:
    """Words with the numbers of the chunks [c * step, c * step + size) that they begin in."""
    last = F.floor(F.col("start_ms") / step_ms)
    first = F.greatest(F.lit(0), F.floor((F.col("start_ms") - size_ms) / step_ms) + 1)
    return words.withColumn("chunk", F.explode(F.sequence(first, last)))


@query(sql("select conv_id, string_agg(tok, ' ' order by pos) as text, true as same from fx_words group by conv_id", "fx_words"))  # chunks that agree give the text again
def chunk_stitch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut into chunks of 9 s every 6 s and stitched: the text again, and whether it is the same."""
    w = fx.words(spark, sf_dir)
    chunked = overlapping_chunks(w, "conv_id", 9000, 6000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "pos"])
        chunks = []
        for c, g in pdf.groupby("chunk"):
            ws = list(zip(g["tok"], g["start_ms"], g["end_ms"], g["prob"], strict=True))
            chunks.append({"start_ms": int(c) * 6000, "end_ms": int(c) * 6000 + 9000, "words": ws})
        return pd.DataFrame({"text": [" ".join(x[0] for x in sequences.stitch(chunks))]})

    stitched = sequences.folded(chunked.select("conv_id", "chunk", "pos", "tok", "start_ms", "end_ms", "prob"), "conv_id", run, "text string")
    whole = w.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("whole"))
    return stitched.join(whole, "conv_id").select("conv_id", "text", (F.col("text") == F.col("whole")).alias("same"))


@query(r"""select doc_id, cast(len(w) as bigint) as n_words, array_to_string(w, ' ') as text
from (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents where text is not null) where len(w) > 0""")
def punct_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words in overlapping chunks joined again, one row a document: their words, as the chunks overlap by
    as much as joining looks at."""
    from talkspan.operators import segment

    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", parts.alias("w")).where(F.size("w") > 0)
    spans = segment.token_spans(F.size("w").cast("long"))
    chunks = d.select("doc_id", F.transform(spans, lambda x: F.slice("w", x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))).alias("parts"))

    def run(doc_id: int, parts: list[list[str]]) -> tuple:
        joined = sequences.join_lists(parts)
        return doc_id, len(joined), " ".join(joined)

    return sequences.each(chunks, run, "doc_id long, n_words long, text string")


@query(sql(r"""
with a as (select conv_id, pos, tok, lead(tok) over o as nt, lag(tok) over o as pt from fx_words window o as (partition by conv_id order by pos)),
b as (select conv_id, pos, case when pt = '.' and regexp_matches(tok, '^\p{Ll}') then replace(upper(tok[1:1]), 'ẞ', 'SS') || tok[2:] else tok end
    || case when regexp_matches(tok, '^\p{L}+$') and regexp_matches(nt, '^\p{Lu}\p{L}*$') then ' .' else '' end as t from a)
select conv_id, string_agg(t, ' ' order by pos) as text from b group by conv_id""", "fx_words"))
def iterative_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with full stops before capitals and sentences begun with capitals, edited until nothing changes."""

    def predict(tokens: list[str], _: int) -> list[tuple[int, str, str]]:
        out = [(i, "append", ".") for i, t in enumerate(tokens[:-1]) if t.isalpha() and tokens[i + 1][:1].isupper() and tokens[i + 1].isalpha()]
        return out + [(i + 1, "case", "CAPITAL") for i, t in enumerate(tokens[:-1]) if t == "." and tokens[i + 1][:1].islower()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": [" ".join(sequences.refine(pdf.sort_values("pos")["tok"].tolist(), predict))]})

    return sequences.folded(fx.words(spark, sf_dir).select("conv_id", "pos", "tok"), "conv_id", run, "text string")


_WITH_NAMES = _SEGMENTS + f""",
ns as (select *, row_number() over (partition by conv_id order by run, part) - 1 as seg_no, 'Người nói ' || (speaker + 1) as name, {list(PALETTE)}[speaker % 8 + 1] as color from seg)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("run", "part")) - 1
    color = F.element_at(F.array(*map(F.lit, PALETTE)), F.col("speaker") % 8 + 1)
    name = F.concat(F.lit("Người nói "), (F.col("speaker") + 1).cast("string"))
    return transcript(spark, sf_dir).withColumn("seg_no", no).withColumn("name", name).withColumn("color", color)


@query(sql(f"""with {_WITH_NAMES},
r as (select *, case when lag(name) over o is null or lag(name) over o <> name then 1 else 0 end as fresh from ns window o as (partition by conv_id order by seg_no)),
b as (select *, sum(fresh) over (partition by conv_id order by seg_no) as block from r),
t as (select conv_id, block, any_value(name) || ':' || chr(10) || string_agg(text, ' ' order by seg_no) as t from b group by conv_id, block)
select conv_id, string_agg(t, chr(10) || chr(10) order by block) as transcript from t group by conv_id""", "fx_words", "fx_conv_turns"))
def plain_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.plain_text(named(spark, sf_dir), "conv_id", "seg_no")


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.result_json(named(spark, sf_dir), fx.words(spark, sf_dir), "conv_id")


@query(sql(f"""with {_WITH_NAMES}
select conv_id, count(*) as n_segments, (select count(*) from fx_words w where w.conv_id = ns.conv_id) as n_words, count(distinct speaker) as n_speakers,
  string_agg(text, ' ' order by seg_no) as text, round(max(end_ms) / 1000.0e0, 3) as last_end, min_by(name, speaker) as first_name, min_by(color, speaker) as first_color from ns group by conv_id""", "fx_words", "fx_conv_turns"))
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document, written and parsed again."""
    d = result_documents(spark, sf_dir).select("conv_id", F.from_json("json", edits.RESULT).alias("d"))
    least = F.array_min(F.map_keys("d.speaker_names"))
    return d.select(
        "conv_id", F.size("d.segments").cast("long").alias("n_segments"), F.size("d.words").cast("long").alias("n_words"), F.size("d.speaker_names").cast("long").alias("n_speakers"), "d.text",
        F.round(F.array_max(F.transform("d.segments", lambda s: s["end_time"])), 3).alias("last_end"), F.col("d.speaker_names")[least].alias("first_name"), F.col("d.speaker_colors")[least].alias("first_color"),
    )


@query(sql(f"""with {_WITH_NAMES},
c as (select conv_id, case when conv_id % 3 = 0 then 1 when conv_id % 3 = 1 then 2 else 3 end as kind from ns group by all)
select ns.conv_id, cast(seg_no as integer) as seg_no, speaker, start_ms, end_ms, text, 1 as level from ns join c on ns.conv_id = c.conv_id where kind = 1
union all select w.conv_id, cast(pos as integer), 0, start_ms, end_ms, tok, 2 from fx_words w join c on w.conv_id = c.conv_id where kind = 2
union all select ns.conv_id, 0, 0, 0, 0, string_agg(text, ' ' order by seg_no), 3 from ns join c on ns.conv_id = c.conv_id where kind = 3 group by ns.conv_id""", "fx_words", "fx_conv_turns"))
def result_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some lack segments, or words as well, read with fallbacks."""
    d = result_documents(spark, sf_dir).select("conv_id", F.from_json("json", edits.RESULT).alias("d"))
    none = F.lit(None)
    kept = F.struct(F.col("d.schema").alias("schema"), F.col("d.text").alias("text"), F.when(F.col("conv_id") % 3 < 2, F.col("d.words")).otherwise(none).alias("words"), F.when(F.col("conv_id") % 3 == 0, F.col("d.segments")).otherwise(none).alias("segments"))
    return edits.parsed(d.select("conv_id", F.to_json(kept).alias("json")), "conv_id")


def _with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.words(spark, sf_dir)
    t = fx.conv_turns(spark, sf_dir).select("conv_id", "turn", "speaker")
    word = F.struct("pos", F.col("tok").alias("text"), "start_ms", "end_ms")
    g = w.join(t, ["conv_id", "turn"]).groupBy("conv_id", "turn", "speaker").agg(F.array_sort(F.collect_list(word)).alias("l"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return g.select("conv_id", "turn", "start_ms", "end_ms", "speaker", F.transform("l", lambda x: x.dropFields("pos")).alias("words"))


@query(sql("""
with g as (select w.conv_id, w.turn, any_value(t.speaker) as speaker, min(w.start_ms) as s, max(w.end_ms) as e, list(struct_pack(text := tok, start_ms := w.start_ms) order by pos) as l, w.conv_id % 9 - 1 as n
  from fx_words w join fx_conv_turns t on w.conv_id = t.conv_id and w.turn = t.turn group by w.conv_id, w.turn),
k as (select *, n > 0 and n < len(l) as cut from g),
a as (select *, case when cut then greatest(s + 1, least(e - 1, case when l[n + 1].start_ms > s and l[n + 1].start_ms < e then l[n + 1].start_ms else s + (e - s) * n // len(l) end)) end as at_ from k),
p as (select conv_id, turn, 0 as half, s as start_ms, coalesce(at_, e) as end_ms, speaker, len(l[1:case when cut then n else len(l) end]) as n_words from a
  union all select conv_id, turn, 1, at_, e, 7, len(l) - n from a where cut)
select conv_id, cast(row_number() over (partition by conv_id order by turn, half) - 1 as bigint) as turn, start_ms, end_ms, speaker, n_words from p""", "fx_words", "fx_conv_turns"))
def split_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn split after conv_id % 9 - 1 words where that is inside; the second part to speaker 7."""
    s = _with_words(spark, sf_dir)
    cuts = s.select("conv_id", "turn", (F.col("conv_id") % 9 - 1).cast("int").alias("n"), F.lit(7).alias("speaker2"))
    out = edits.split_segments(s, cuts, ["conv_id"], "turn")
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "start_ms", "end_ms", "speaker", F.size("words").cast("long").alias("n_words"))


@query(sql("""
select conv_id, turn, start_ms, end_ms, case when turn between 1 and 2 then coalesce((select p.speaker from fx_conv_turns p where p.conv_id = t.conv_id and p.turn = 0), speaker) else speaker end as speaker from fx_conv_turns t""", "fx_conv_turns"))
def merge_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.conv_turns(spark, sf_dir)
    picks = t.select("conv_id").distinct().select("conv_id", F.lit(1).alias("first"), F.lit(2).alias("last"))
    return edits.merge_block(t, picks, ["conv_id"], "turn")


@query(sql("""
with a as (select *, case when lag(speaker) over o is null or lag(speaker) over o <> speaker then 1 else 0 end as fresh from fx_turns window o as (partition by item_id order by turn_no)),
b as (select *, sum(fresh) over (partition by item_id order by turn_no) as block from a),
h as (select item_id, block from b where turn_no = 10)
select b.item_id, turn_no, start_ms, end_ms, case when h.block is not null then 9 else speaker end as speaker, event_id from b left join h on b.item_id = h.item_id and b.block = h.block""", "fx_turns"))
def reassign_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.turns(spark, sf_dir)
    picks = t.select("item_id").distinct().select("item_id", F.lit(10).alias("at"), F.lit(9).alias("speaker2"))
    return edits.reassign_block(t, picks, ITEM, "turn_no")


@query("""
with s as (select unnest([0, 1, 2]) as speaker, unnest(['A', 'B', 'C']) as name, unnest(['#1', '#2', '#3']) as color), c as (select unnest([1, 2, 5]) as speaker, unnest(['Lan', null, 'New']) as n, unnest([null, '#9', '#5']) as k)
select coalesce(s.speaker, c.speaker) as speaker, coalesce(n, name) as name, coalesce(k, color) as color from s full join c on s.speaker = c.speaker""")
def rename_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "speaker int, name string, color string"
    speakers = spark.createDataFrame([(0, "A", "#1"), (1, "B", "#2"), (2, "C", "#3")], schema)
    return edits.rename(speakers, spark.createDataFrame([(1, "Lan", None), (2, None, "#9"), (5, "New", "#5")], schema))
