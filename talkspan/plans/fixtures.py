"""Views that turn the driver's tables into timed sequences; times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, turn_no, start_ms, end_ms, speaker int, event_id: speaker turns made of events."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    item = F.col("user_id") % 16
    rn = F.row_number().over(Window.partitionBy("item_id").orderBy("ts", "event_id")).cast("long")
    speaker = F.when(F.col("event_type").isin("click", "view"), 0).when(F.col("event_type").isin("signup", "purchase"), 1).otherwise(2)
    rows = e.withColumn("item_id", item).withColumn("turn_no", rn)
    rows = rows.withColumn("start_ms", 5000 * F.col("turn_no") + (F.col("event_id") * 7919) % 4000)
    rows = rows.withColumn("end_ms", F.col("start_ms") + F.round(F.col("value") * 100).cast("long"))
    return rows.select("item_id", "turn_no", "start_ms", "end_ms", speaker.alias("speaker"), "event_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, frame_no, prob: a probability per event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 16).alias("item_id"), "value")
    rn = F.row_number().over(Window.partitionBy("item_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.select("item_id", rn.alias("frame_no"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, pos, turn, tok, start_ms, end_ms, prob: words of conversations with made-up timings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    parts = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    each = c.select("conv_id", "turn", F.posexplode(parts).alias("i", "tok"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")).cast("long") - 1
    rows = each.select("conv_id", "turn", pos.alias("pos"), "tok").withColumn("start_ms", 300 * F.col("pos"))
    end = F.col("start_ms") + 100 + 40 * F.least(F.length("tok"), F.lit(10))
    return rows.select("conv_id", "pos", "turn", "tok", "start_ms", end.cast("long").alias("end_ms"), (((F.col("pos") * 37) % 100) / 100).alias("prob"))


def conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, start_ms, end_ms, speaker: a turn per message; every fifth is missing and odd ones overlap."""
    w = words(spark, sf_dir)
    role = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    spans = w.groupBy("conv_id", "turn").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where("turn % 5 <> 4")
    start = 300 * F.col("a") - F.when(F.col("turn") % 2 == 1, 450).otherwise(0)
    speaker = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return spans.join(role, ["conv_id", "turn"]).select("conv_id", "turn", start.cast("long").alias("start_ms"), (300 * F.col("b") + 300).alias("end_ms"), speaker.alias("speaker"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, win_no, start_ms, end_ms, label, vector: embeddings as overlapping windows with label signal."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select((F.col("vec_id") / 40).cast("long").alias("item_id"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("win_no", F.row_number().over(Window.partitionBy("item_id").orderBy("vec_id")).cast("long") - 1)
    raw = F.transform("v", lambda x, i: 0.3 * x + F.when(i == F.col("label") % 4, 1.0).otherwise(0.0))
    rows = rows.withColumn("raw", raw).withColumn("norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x)))
    vector = F.transform("raw", lambda x: x / F.col("norm"))
    return rows.select("item_id", "win_no", (600 * F.col("win_no")).alias("start_ms"), (600 * F.col("win_no") + 1500).alias("end_ms"), "label", vector.alias("vector"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, chunk, frame, s0, s1, s2: activity bits of three local speakers."""
    t = turns(spark, sf_dir)
    bits = [F.when((F.col("event_id") * (31 + s)) % 5 < 2, 1).otherwise(0).alias(f"s{s}") for s in range(3)]
    return t.select("item_id", F.floor(F.col("turn_no") / 20).alias("chunk"), (F.col("turn_no") % 20).alias("frame"), *bits)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, seg_no, start, end in samples at 16 kHz."""
    return turns(spark, sf_dir).select("item_id", F.col("turn_no").alias("seg_no"), (F.col("start_ms") * 16).alias("start"), (F.col("end_ms") * 16).alias("end"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, display_name, original_name, status, source_bytes, updated_ms: a catalogue of items."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    status = F.element_at(F.array(*map(F.lit, ("processing", "complete", "error", "cancelled"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.coalesce("source", F.lit("unknown"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.concat_ws("-", name, F.col("doc_id").cast("string")).alias("display_name"), F.concat(name, F.lit(".wav")).alias("original_name"),
        status.alias("status"), F.col("n_chars").alias("source_bytes"), (F.lit(1700000000000) + (F.col("doc_id") * 7919) % 1000000).alias("updated_ms"),
    )


def hotword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, line: lines of a phrase list with scores and comments."""
    b = table(spark, sf_dir, "benchmark")
    first = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 3), " ")
    score = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" :"), (((F.col("item_id") * 7) % 90) / 10).cast("string"))).otherwise("")
    mark = F.when(F.col("item_id") % 10 == 9, "# ").otherwise("")
    return b.select(F.col("item_id").alias("pos"), F.concat(mark, first, score).alias("line"))


#: The same views for DuckDB.
SQL = {
    "fx_turns": """select user_id % 16 as item_id, rn as turn_no, 5000 * rn + (event_id * 7919) % 4000 as start_ms,
        5000 * rn + (event_id * 7919) % 4000 + cast(round(value * 100) as bigint) as end_ms,
        case when event_type in ('click', 'view') then 0 when event_type in ('signup', 'purchase') then 1 else 2 end as speaker, event_id
      from (select *, row_number() over (partition by user_id % 16 order by ts, event_id) as rn from events)""",
    "fx_frames": """select user_id % 16 as item_id, row_number() over (partition by user_id % 16 order by ts, event_id) - 1 as frame_no,
        least(1.0, value / 100) as prob from events""",
    "fx_words": """select conv_id, pos, turn, tok, 300 * pos as start_ms, cast(300 * pos + 100 + 40 * least(length(tok), 10) as bigint) as end_ms, ((pos * 37) % 100) / 100.0e0 as prob
      from (select conv_id, turn, tok, row_number() over (partition by conv_id order by turn, i) - 1 as pos
        from (select conv_id, turn, unnest(l) as tok, unnest(range(len(l))) as i from
          (select conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as l from conversations)))""",
    "fx_conv_turns": """select conv_id, turn, cast(300 * min(pos) - case when turn % 2 = 1 then 450 else 0 end as bigint) as start_ms, cast(300 * max(pos) + 300 as bigint) as end_ms,
        case any_value(role) when 'system' then 0 when 'user' then 1 else 2 end as speaker
      from fx_words join (select distinct conv_id, turn, role from conversations) using (conv_id, turn) where turn % 5 <> 4 group by conv_id, turn""",
    "fx_windows": """select item_id, win_no, 600 * win_no as start_ms, 600 * win_no + 1500 as end_ms, label,
        list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) as vector
      from (select vec_id // 40 as item_id, row_number() over (partition by vec_id // 40 order by vec_id) - 1 as win_no, label,
          list_transform(range(1, len(embedding) + 1), lambda i: 0.3e0 * cast(embedding[i] as double) + case when i - 1 = label % 4 then 1.0e0 else 0.0e0 end) as raw
        from embeddings)""",
    "fx_mask": """select item_id, turn_no // 20 as chunk, turn_no % 20 as frame, case when (event_id * 31) % 5 < 2 then 1 else 0 end as s0,
        case when (event_id * 32) % 5 < 2 then 1 else 0 end as s1, case when (event_id * 33) % 5 < 2 then 1 else 0 end as s2 from fx_turns""",
    "fx_segments": "select item_id, turn_no as seg_no, start_ms * 16 as start, end_ms * 16 as end_ from fx_turns",
    "fx_library": """select cast(doc_id as varchar) as id, coalesce(source, 'unknown') || '-' || doc_id as display_name, coalesce(source, 'unknown') || '.wav' as original_name,
        ['processing', 'complete', 'error', 'cancelled'][doc_id % 4 + 1] as status, n_chars as source_bytes, 1700000000000 + (doc_id * 7919) % 1000000 as updated_ms from documents""",
    "fx_hotword_lines": """select item_id as pos, case when item_id % 10 = 9 then '# ' else '' end || array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:3], ' ')
        || case when item_id % 2 = 0 then ' :' || cast(((item_id * 7) % 90) / 10.0e0 as varchar) else '' end as line from benchmark""",
}
_NEEDS = {"fx_conv_turns": ("fx_words",), "fx_mask": ("fx_turns",), "fx_segments": ("fx_turns",)}


def sql(body: str, *views: str) -> str:
    """body as a statement over the named views (CTEs); body begins with further CTEs or with select."""
    names: list[str] = []
    for v in views:
        for n in (*_NEEDS.get(v, ()), v):
            if n not in names:
                names.append(n)
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    body = body.strip()
    return f"with {ctes}" + (",\n" + body.removeprefix("with ") if body.startswith("with ") else "\n" + body)
