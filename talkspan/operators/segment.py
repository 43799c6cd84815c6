"""Segmentation: hysteresis, masks, chunks, windows, and words out of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows_of_ms(ms: int, frame: int = 512, rate: int = 16_000) -> int:
    """Whole frames in ms."""
    return ms * rate // 1000 // frame


def hysteresis(frames: DataFrame, key: str, threshold: float, min_speech_ms: int = 250, min_silence_ms: int = 100, pad_ms: int = 1000, merge_ms: int = 250, frame: int = 512, rate: int = 16_000) -> DataFrame:
    """key, start, end in samples: speech where the probability reaches the threshold.

    frames: key, frame_no from 0 without gaps, prob. A run goes on over fewer than min_silence low frames and ends at
    its last high one, or at the last frame if fewer low frames follow. Runs of min_speech or more are padded, clamped
    to the item, and joined to the next when less than merge_ms apart. Null and NaN probabilities are low.
    """
    silence, speech = windows_of_ms(min_silence_ms, frame, rate), windows_of_ms(min_speech_ms, frame, rate)
    pad, near = pad_ms * rate // 1000, merge_ms * rate // 1000
    total = frames.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("frame_no")
    hi = frames.where(~F.isnan("prob") & (F.col("prob") >= threshold)).select(key, "frame_no")
    prev = F.lag("frame_no").over(w)
    hi = hi.withColumn("_new", F.when(prev.isNull() | (F.col("frame_no") - prev > silence), 1).otherwise(0)).withColumn("isl", F.sum("_new").over(w))
    runs = hi.groupBy(key, "isl").agg(F.min("frame_no").alias("a"), (F.max("frame_no") + 1).alias("b")).join(total, key)
    runs = runs.withColumn("b", F.when(F.col("n") - F.col("b") < silence, F.col("n")).otherwise(F.col("b"))).where(F.col("b") - F.col("a") >= speech)
    size = F.col("n") * frame
    runs = runs.select(key, "isl", F.greatest(F.lit(0).cast("long"), F.col("a") * frame - pad).alias("start"), F.least(size, F.col("b") * frame + pad).alias("end"))
    o = Window.partitionBy(key).orderBy("isl")
    apart = F.lag("end").over(o).isNull() | (F.col("start") - F.lag("end").over(o) >= near)
    runs = runs.withColumn("part", F.sum(apart.cast("int")).over(o))
    return runs.groupBy(key, "part").agg(F.min_by("start", "isl").alias("start"), F.max_by("end", "isl").alias("end")).drop("part")


def with_retry(frames: DataFrame, key: str, first: tuple[float, int] = (0.2, 250), second: tuple[float, int] = (0.3, 150), frame: int = 512) -> DataFrame:
    """key, start, end, attempt: hysteresis() at `first` (threshold, min_speech_ms); items without speech at `second`;
    those still without are speech from end to end (attempt 3)."""
    one = hysteresis(frames, key, *first, frame=frame).withColumn("attempt", F.lit(1))
    two = hysteresis(frames, key, *second, frame=frame).withColumn("attempt", F.lit(2))
    whole = frames.groupBy(key).agg((F.count("*") * frame).alias("end")).select(key, F.lit(0).cast("long").alias("start"), "end", F.lit(3).alias("attempt"))
    every = one.unionByName(two).unionByName(whole)
    least = F.min("attempt").over(Window.partitionBy(key))
    return every.withColumn("_least", least).where("attempt = _least").drop("_least")


def mask_regions(frames: DataFrame, key: str, active: Column, step_ms: int, min_speech_ms: int = 250, min_silence_ms: int = 100) -> DataFrame:
    """key, start_ms, end_ms: runs of active frames; short ones go, then those less than min_silence apart join."""
    w = Window.partitionBy(key).orderBy("frame_no")
    on = frames.where(active).select(key, "frame_no").withColumn("run", F.col("frame_no") - F.row_number().over(w))
    runs = on.groupBy(key, "run").agg((F.min("frame_no") * step_ms).alias("start_ms"), ((F.max("frame_no") + 1) * step_ms).alias("end_ms"))
    runs = runs.where(F.col("end_ms") - F.col("start_ms") >= min_speech_ms)
    o = Window.partitionBy(key).orderBy("start_ms")
    apart = F.lag("end_ms").over(o).isNull() | (F.col("start_ms") - F.lag("end_ms").over(o) >= min_silence_ms)
    runs = runs.withColumn("part", F.sum(apart.cast("int")).over(o))
    return runs.groupBy(key, "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("part")


def overlapped_chunks(spans: DataFrame, keys: list[str], size: int, back: int) -> DataFrame:
    """keys, chunk, start, end: spans cut every `size`; all but a span's first chunk begin `back` earlier."""
    c = spans.where("end > start").select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.posexplode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("long"))).alias("chunk", "c"))
    start = F.when(F.col("chunk") == 0, F.col("c")).otherwise(F.greatest("_s", F.col("c") - back))
    return c.select(*keys, "chunk", start.alias("start"), F.least("_e", F.col("c") + size).alias("end"))


def token_spans(n: Column, size: int = 56, overlap: int = 16) -> Column:
    """array<struct<start,end>>: token ranges. Up to `size` tokens make one chunk; less than two steps and an overlap
    two halves that share it; else chunks of `size` every size - overlap."""
    step = size - overlap
    half = F.floor((n + overlap + 1) / 2)
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    zero = F.lit(0)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((n - size) / step)) * step, F.lit(step).cast("long")), lambda s: span(s, F.least(s + size, n)))
    return F.when(n <= 0, F.array().cast("array<struct<start:bigint,end:bigint>>")).when(n <= size, F.array(span(zero, n))).when(n < 2 * step + overlap, F.array(span(zero, half), span(half - overlap, n))).otherwise(many)


def token_chunks(rows: DataFrame, keys: list[str], n: Column, size: int = 56, overlap: int = 16) -> DataFrame:
    """keys, chunk, start, end: a row for each of token_spans()."""
    return rows.select(*keys, F.posexplode(token_spans(n, size, overlap)).alias("chunk", "x")).select(*keys, "chunk", "x.start", "x.end")


def hop_starts(rows: DataFrame, keys: list[str], n: Column, size: int = 160_000, step: int = 80_000) -> DataFrame:
    """keys, chunk, start: starts every `step`, until a chunk of `size` reaches the end."""
    last = F.greatest(F.lit(0), F.floor((n - size) / step) + 1)
    return rows.select(*keys, F.posexplode(F.sequence(F.lit(0).cast("long"), last * step, F.lit(step).cast("long"))).alias("chunk", "start"))


def sliding_windows(rows: DataFrame, keys: list[str], n: Column, size: int = 150, hop: int = 60) -> DataFrame:
    """keys, win, start, end in frames: whole windows every hop, and one that ends with the region; short regions are
    one window."""
    starts = F.when(n <= size, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.sequence(F.lit(0).cast("long"), n - size, F.lit(hop).cast("long")), F.array((n - size).cast("long"))))
    return rows.where(n > 0).select(*keys, n.alias("_n"), F.posexplode(F.array_distinct(starts)).alias("win", "start")).select(*keys, "win", "start", F.least(F.col("_n"), F.col("start") + size).alias("end"))


def rechunk(rows: DataFrame, keys: list[str], words: Column, start: Column, end: Column, most: int = 40, size: int = 32) -> DataFrame:
    """keys, part, text, n_words, start_ms, end_ms: texts of more than `most` words in parts of `size`, with times in
    proportion."""
    per = F.when(F.size(words) > most, F.lit(size)).otherwise(F.greatest(F.size(words), F.lit(1)))
    r = rows.withColumn("_w", words).withColumn("_n", F.size("_w")).withColumn("_per", per).withColumn("_s", start).withColumn("_e", end).where("_n > 0")
    r = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_per")).cast("int") - 1)))
    piece = F.slice("_w", F.col("part") * F.col("_per") + 1, F.col("_per"))
    at = lambda i: F.col("_s") + F.floor((F.col("_e") - F.col("_s")) * F.least(i, F.col("_n")) / F.col("_n"))
    return r.select(*keys, "part", F.array_join(piece, " ").alias("text"), F.size(piece).alias("n_words"), at(F.col("part") * F.col("_per")).alias("start_ms"), at((F.col("part") + 1) * F.col("_per")).alias("end_ms"))


def pause_hints(words: DataFrame, key: str) -> DataFrame:
    """key, pos, pause_ms: silence after each word; a second after the last; a second or more before another speaker.
    Items of one word have none."""
    w = Window.partitionBy(key).orderBy("pos")
    gap = F.greatest(F.lit(0).cast("long"), F.lead("start_ms").over(w) - F.col("end_ms"))
    other = F.lead("speaker").over(w) != F.col("speaker")
    second = F.lit(1000).cast("long")
    hint = F.when(F.lead("pos").over(w).isNull(), second).when(other, F.greatest(second, gap)).otherwise(gap)
    rows = words.withColumn("pause_ms", hint).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return rows.where("_n >= 2").select(key, "pos", "pause_ms")


def words_of_tokens(tokens: DataFrame, key: str, mark: str = "▁") -> DataFrame:
    """key, word, text, start_ms, end_ms, prob: tokens (key, pos, piece, at_ms, lp) to words.

    A token that begins with a mark or a space begins a word. A word lasts until the next token's time, its last
    token's plus the mean step (80 ms if there is but one token), the next word's start, or 400 ms, whichever is
    first; at least 10 ms. Its probability is its tokens' mean. Words without text go.
    """
    w = Window.partitionBy(key).orderBy("pos")
    all_ = Window.partitionBy(key)
    begins = F.col("piece").startswith(mark) | F.col("piece").startswith(" ") | F.lag("pos").over(w).isNull()
    n = F.count("*").over(all_)
    step = F.when(n > 1, (F.max("at_ms").over(all_) - F.min("at_ms").over(all_)) / (n - 1)).otherwise(80.0)
    t = tokens.withColumn("step", step).withColumn("word", F.sum(begins.cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    g = t.groupBy(key, "word").agg(F.trim(F.translate(text, mark, " ")).alias("text"), F.min_by("at_ms", "pos").alias("start_ms"), F.max_by("at_ms", "pos").alias("last_ms"), F.first("step").alias("step"), F.avg(F.exp("lp")).alias("prob"))
    nxt = F.lead("start_ms").over(Window.partitionBy(key).orderBy("word"))
    end = F.least(F.col("last_ms") + F.col("step"), nxt, F.col("start_ms") + 400)
    g = g.withColumn("end_ms", F.floor(F.when(end <= F.col("start_ms"), F.col("start_ms") + 10).otherwise(end)))
    return g.where("text <> ''").select(key, "word", "text", "start_ms", "end_ms", "prob")


def frame_count(n: Column, length: int, shift: int, snip: bool) -> Column:
    """Frames of n samples: only whole ones if snip, else one per shift."""
    if snip:
        return F.when(n < length, F.lit(0).cast("long")).otherwise(1 + F.floor((n - length) / shift))
    return F.floor((n + shift // 2) / shift)


def first_sample(frame: Column, length: int, shift: int, snip: bool) -> Column:
    """First sample of a frame; without snip frames stand about their middle and may begin before 0."""
    return frame * shift if snip else frame * shift + shift // 2 - length // 2


def sentence_groups(words: DataFrame, key: str, most: int = 34, least: int = 10, terminal: str = "[.?!:]$") -> DataFrame:
    """key, seg_no, speaker, n_words, start_ms, end_ms, text: the writer's groups.

    A group ends before a word of another speaker, after `most` words, or after `least` words at a terminal mark. As
    its size starts anew with each group, it is a fold over the item's words.
    """
    word = "struct<pos:bigint,tok:string,start_ms:bigint,end_ms:bigint,speaker:int>"
    rows = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "tok", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("speaker").cast("int").alias("speaker")))).alias("w"))
    # first the numbers of the words that begin a group: (size of the open group, its last speaker, beginnings)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit(None).cast("int").alias("sp"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        new = (a["i"] == 0) | ~a["sp"].eqNullSafe(x["speaker"]) | a["full"]
        n = F.when(new, 1).otherwise(a["n"] + 1)
        full = (n >= most) | ((n >= least) & x["tok"].rlike(terminal))
        return F.struct(n.alias("n"), full.alias("full"), x["speaker"].alias("sp"), F.when(new, F.array_append(a["at"], a["i"])).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))

    rows = rows.withColumn("at", F.aggregate("w", start, step, lambda a: a["at"])).withColumn("_size", F.size("w"))
    rows = rows.select(key, "w", "_size", "at", F.posexplode("at").alias("seg_no", "a"))
    rows = rows.withColumn("b", F.coalesce(F.try_element_at("at", F.col("seg_no") + 2), F.col("_size")))
    rows = rows.withColumn("g", F.slice("w", F.col("a") + 1, F.col("b") - F.col("a")).cast(f"array<{word}>"))
    return rows.select(key, "seg_no", F.col("g")[0]["speaker"].alias("speaker"), F.size("g").alias("n_words"), F.col("g")[0]["start_ms"].alias("start_ms"), F.array_max(F.transform("g", lambda x: x["end_ms"])).alias("end_ms"), F.array_join(F.transform("g", lambda x: x["tok"]), " ").alias("text"))
