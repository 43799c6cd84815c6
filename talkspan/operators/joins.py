"""Joins on time. Each has an equality on the item (and a time bucket where spans can be many), so none becomes a
nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_interval(start: Column, end: Column, cap: int = 400) -> tuple[Column, Column]:
    """A word's interval: an end of 0 or none is the start, reversed ends swap, no longer than cap, and cap if empty."""
    s = F.coalesce(start, F.lit(0))
    e = F.when(end.isNull() | (end == 0), s).otherwise(end)
    low, high = F.least(s, e), F.greatest(s, e)
    return low, F.when(high <= low, low + cap).otherwise(F.least(high, low + cap))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length, 0 if apart; null if any end is null."""
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(known, F.greatest(F.lit(0).cast("long"), F.least(a1, b1) - F.greatest(a0, b0)))


def bucketed(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """A row for each time bucket that [start, end] touches."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width)))))


def attribute_words(words: DataFrame, turns: DataFrame, key: str, word_no: str = "pos", turn_no: str = "turn", bucket_ms: int = 60_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, word_no, speaker int, how, and the columns `keep` of words: the speaker of each word.

    The turn with the greatest overlap, then the nearest centre, then the first. Without overlap ("near") the nearer
    of the last turn that ended by the word's centre and the next that starts after it; the earlier at a tie, and
    speaker 0 ("none") if there is no turn. Negative speakers count as 0. words: key, word_no, start_ms, end_ms;
    turns: key, turn_no, start_ms, end_ms, speaker. Both sides meet on item and time bucket; the nearest turns come
    from one pass over words and turns in time order.
    """
    s, e = word_interval(F.col("start_ms"), F.col("end_ms"))
    carried = F.struct(F.lit(0).alias("_"), *keep).alias("kept")
    w = words.select(key, word_no, s.alias("ws"), e.alias("we"), carried).withColumn("c2", F.col("ws") + F.col("we"))
    t = turns.select(key, F.col(turn_no).alias("t_no"), F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"), F.greatest(F.lit(0), F.col("speaker")).alias("speaker"))
    wb = bucketed(w.drop("kept"), F.col("ws"), F.col("we"), bucket_ms)
    tb = bucketed(t, F.col("ts"), F.col("te"), bucket_ms)
    pairs = wb.join(tb, [key, "_bucket"]).where("ws < te and ts < we")
    distance = F.abs(F.col("ts") + F.col("te") - F.col("c2"))
    score = F.struct((-(F.least("we", "te") - F.greatest("ws", "ts"))).alias("o"), distance.alias("d"), "t_no", "speaker")
    best = pairs.groupBy(key, word_no).agg(F.min(score)["speaker"].alias("over"))
    # nearest turns: words and turn ends in one order, the last turn end by the centre, the first start after it
    none = F.lit(None)
    end = "struct<te:bigint,o:bigint,speaker:int>"
    begin = "struct<ts:bigint,o:bigint,speaker:int>"
    kept = w.schema["kept"].dataType
    ends = F.struct("te", (-F.col("t_no")).cast("long").alias("o"), "speaker").cast(end)
    starts = F.struct("ts", F.col("t_no").cast("long").alias("o"), "speaker").cast(begin)
    row = lambda word, at, kind, e, s, k: (word.cast("long").alias("word"), at.alias("at"), F.lit(kind).alias("kind"), e.cast(end).alias("ended"), s.cast(begin).alias("starts"), k.cast(kept).alias("kept"))
    events = t.select(key, *row(none, 2 * F.col("te"), 0, ends, none, none))
    events = events.union(t.select(key, *row(none, 2 * F.col("ts"), 2, none, starts, none)))
    events = events.union(w.select(key, *row(F.col(word_no), F.col("c2"), 1, none, none, F.col("kept"))))
    line = Window.partitionBy(key).orderBy("at", "kind")
    past, rest = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    near = events.withColumn("p", F.max("ended").over(past)).withColumn("n", F.min("starts").over(rest)).where("word is not null")
    before, after = F.col("at") - 2 * F.col("p.te"), 2 * F.col("n.ts") - F.col("at")
    pick = F.when(F.col("p").isNull(), F.col("n.speaker")).when(F.col("n").isNull() | (before <= after), F.col("p.speaker")).otherwise(F.col("n.speaker"))
    near = near.select(key, F.col("word").alias(word_no), pick.alias("near"), "kept")
    out = near.join(best, [key, word_no], "left")
    how = F.when(F.col("over").isNotNull(), "overlap").when(F.col("near").isNotNull(), "near").otherwise("none")
    return out.select(key, word_no, F.coalesce("over", "near", F.lit(0)).cast("int").alias("speaker"), how.alias("how"), *[F.col(f"kept.{c}").alias(c) for c in keep])


def count_inside(spans: DataFrame, words: DataFrame, key: str, span_no: str, word_no: str = "pos", bucket_ms: int = 60_000) -> DataFrame:
    """key, span_no, n_words: words whose middle lies in [start_ms, end_ms]; -1 for items without words."""
    w = words.select(key, F.col(word_no).alias("_w"), (F.col("start_ms") + F.col("end_ms")).alias("c2")).withColumn("_bucket", F.floor(F.col("c2") / 2 / bucket_ms))
    b = bucketed(spans.select(key, span_no, "start_ms", "end_ms"), F.col("start_ms"), F.col("end_ms"), bucket_ms)
    hits = b.join(w, [key, "_bucket"]).where("c2 between 2 * start_ms and 2 * end_ms").groupBy(key, span_no).agg(F.count("*").alias("hits"))
    any_ = words.select(F.col(key)).distinct().withColumn("known", F.lit(True))
    out = spans.select(key, span_no).join(hits, [key, span_no], "left").join(any_, key, "left")
    return out.select(key, span_no, F.when(F.col("known"), F.coalesce("hits", F.lit(0))).otherwise(-1).cast("long").alias("n_words"))


def active_at(times: DataFrame, segments: DataFrame, key: str, time_no: str, slack: int = 35) -> DataFrame:
    """key, time_no, seg_no: the last segment that starts by t_ms + slack; 0 if none. times: key, time_no, t_ms."""
    s = segments.select(key, F.lit(None).cast("long").alias("_no"), (F.col("start_ms") - slack).alias("at"), F.lit(0).alias("kind"), F.struct("start_ms", "seg_no").alias("seg"))
    t = times.select(key, F.col(time_no).cast("long"), F.col("t_ms"), F.lit(1), F.lit(None).cast(s.schema["seg"].dataType))
    line = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = s.union(t).withColumn("last", F.max("seg").over(line)).where("kind = 1")
    return rows.select(key, F.col("_no").alias(time_no), F.coalesce("last.seg_no", F.lit(0)).cast("long").alias("seg_no"))


def chunk_intersections(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, chunk, start, end: spans cut at multiples of width and counted from their chunk's start."""
    last = F.greatest(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    rows = spans.where("end > start").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
    start = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("chunk") * width)
    end = F.least(F.lit(width).cast("long"), F.col("end") - F.col("chunk") * width)
    return rows.select(*keys, "chunk", start.alias("start"), end.alias("end")).where("end > start")


def timeline_window(spans: DataFrame, keys: list[str], ordinal: str, begin: int, length: int) -> DataFrame:
    """keys, ordinal, start, end: what of the source lies in [begin, begin + length) of the spans laid end to end."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("at", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))
    start = F.col("start") + F.greatest(F.lit(0), F.lit(begin) - F.col("at"))
    end = F.least(F.col("end"), F.col("start") + (begin + length) - F.col("at"))
    return rows.select(*keys, ordinal, start.alias("start"), end.alias("end")).where("end > start")
