"""Edits of transcripts, and the documents made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspan.operators import merge

WORD = "struct<text:string,start_ms:bigint,end_ms:bigint>"


def split_time(words: Column, n: Column, start: Column, end: Column) -> Column:
    """Where a segment splits after n words: the next word's start if it lies inside, else in proportion to the words;
    at least 1 ms from either end."""
    at = F.try_element_at(words, (n + 1).cast("int"))["start_ms"]
    share = start + F.floor((end - start) * n / F.size(words))
    return F.greatest(start + 1, F.least(end - 1, F.when((at > start) & (at < end), at).otherwise(share)))


def split_segments(segments: DataFrame, cuts: DataFrame, keys: list[str], no: str) -> DataFrame:
    """keys, no (from 0 anew), start_ms, end_ms, speaker, words: segments (keys, no, start_ms, end_ms, speaker, words)
    split after n words (cuts: keys, no, n, speaker2). The second part's speaker is speaker2, or the same if null. No
    split at 0 words or fewer, or at all of them or more."""
    s = segments.join(cuts, [*keys, no], "left")
    size = F.size("words")
    cut = F.when((F.col("n") > 0) & (F.col("n") < size), F.col("n").cast("int"))
    at = split_time(F.col("words"), cut, F.col("start_ms"), F.col("end_ms"))
    part = lambda a, b, sp, w: F.struct(a.alias("start_ms"), b.alias("end_ms"), sp.alias("speaker"), w.alias("words"))
    whole = F.array(part(F.col("start_ms"), F.col("end_ms"), F.col("speaker"), F.col("words")))
    n = F.coalesce(cut, F.lit(1))
    two = F.array(
        part(F.col("start_ms"), at, F.col("speaker"), F.slice("words", 1, n)),
        part(at, F.col("end_ms"), F.coalesce("speaker2", "speaker"), F.slice("words", n + 1, F.greatest(F.lit(0), size - n))),
    )
    s = s.select(*keys, no, F.posexplode(F.when(cut.isNotNull(), two).otherwise(whole)).alias("_i", "x"))
    new = F.row_number().over(Window.partitionBy(*keys).orderBy(no, "_i")) - 1
    return s.select(*keys, new.alias(no), "x.start_ms", "x.end_ms", "x.speaker", "x.words")


def rebuilt(words: Column) -> Column:
    """struct<text, start_ms, end_ms> of a segment's words: from the first's start to the greatest end."""
    return F.struct(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), words[0]["start_ms"].alias("start_ms"), F.array_max(F.transform(words, lambda w: w["end_ms"])).alias("end_ms"))


def merge_block(segments: DataFrame, picks: DataFrame, keys: list[str], no: str, into: str = "previous") -> DataFrame:
    """segments whose picked stretch (picks: keys, first, last) takes the speaker before it, or after it; stretches
    without such a neighbour stay."""
    s = segments.join(picks, keys, "left")
    inside = F.coalesce(F.col(no).between(F.col("first"), F.col("last")), F.lit(False))
    w = Window.partitionBy(*keys)
    at = F.col("first") - 1 if into == "previous" else F.col("last") + 1
    other = F.max(F.when(F.col(no) == at, F.col("speaker"))).over(w)
    return s.withColumn("speaker", F.when(inside, F.coalesce(other, F.col("speaker"))).otherwise(F.col("speaker"))).select(segments.columns)


def reassign_block(segments: DataFrame, picks: DataFrame, keys: list[str], no: str) -> DataFrame:
    """segments with the block (neighbours of one speaker) around each picked one (picks: keys, at, speaker2) given to
    speaker2."""
    b = merge.blocks(segments, keys, no)
    hit = b.join(picks, keys).where(F.col(no) == F.col("at")).select(*keys, "block", "speaker2")
    out = b.join(hit, [*keys, "block"], "left")
    return out.withColumn("speaker", F.coalesce("speaker2", "speaker")).select(segments.columns)


def rename(speakers: DataFrame, changes: DataFrame) -> DataFrame:
    """speakers (speaker, name, color) with names and colours of changes where these are not null; new ids are added."""
    c = changes.select("speaker", F.col("name").alias("_n"), F.col("color").alias("_c"))
    return speakers.join(c, "speaker", "full").select("speaker", F.coalesce("_n", "name").alias("name"), F.coalesce("_c", "color").alias("color"))


def plain_text(segments: DataFrame, key: str, no: str, name: str = "name", text: str = "text") -> DataFrame:
    """key, transcript: "Name:" and the text of each block of one speaker, blank lines between blocks."""
    rows = merge.runs(segments, [key], [no], name, "_block")
    ordered = lambda by, what: F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what])
    b = rows.groupBy(key, "_block").agg(F.first(name).alias(name), F.array_join(ordered(no, text), " ").alias(text))
    b = b.withColumn("_t", F.concat(name, F.lit(":\n"), text))
    return b.groupBy(key).agg(F.array_join(ordered("_block", "_t"), "\n\n").alias("transcript"))


def result_json(segments: DataFrame, words: DataFrame, key: str, schema: str = "talkspan-1") -> DataFrame:
    """key, json: the nested document of an item, from segments (key, seg_no, start_ms, end_ms, speaker, name, color,
    text) and words (key, pos, tok, start_ms, end_ms, prob). Times are seconds."""
    sec = lambda c: F.col(c) / 1000
    row = lambda order, *cols: F.transform(F.array_sort(F.collect_list(F.struct(order, *cols))), lambda x: x.dropFields(order))
    pairs = lambda v: F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("speaker").cast("string").alias("k"), F.col(v).alias("v")))))
    one = row("seg_no", F.lit("text").alias("type"), F.col("speaker").alias("speaker_id"), sec("start_ms").alias("start_time"), sec("end_ms").alias("end_time"), "text")
    s = segments.groupBy(key).agg(one.alias("segments"), pairs("name").alias("speaker_names"), pairs("color").alias("speaker_colors"))
    s = s.withColumn("text", F.array_join(F.transform("segments", lambda x: x["text"]), " "))
    w = words.groupBy(key).agg(row("pos", F.col("tok").alias("text"), sec("start_ms").alias("start"), sec("end_ms").alias("end"), F.col("prob").alias("probability")).alias("words"))
    doc = F.struct(F.lit(schema).alias("schema"), "text", "words", "segments", "speaker_names", "speaker_colors")
    return s.join(w, key, "left").select(key, F.to_json(doc).alias("json"))


RESULT = "schema string, text string, words array<struct<text:string,start:double,end:double,probability:double>>, segments array<struct<type:string,speaker_id:int,start_time:double,end_time:double,start:double,end:double,text:string>>, speaker_names map<string,string>, speaker_colors map<string,string>"


def parsed(documents: DataFrame, key: str, json: str = "json") -> DataFrame:
    """key, seg_no, speaker, start_ms, end_ms, text, level of JSON documents: their segments (level 1; fields may be
    called start or start_time), else their words, one by one (2), else their plain text (3). Documents that are no
    JSON, or hold nothing, give no rows."""
    d = documents.select(key, F.from_json(json, RESULT).alias("d"))
    ms = lambda c: F.floor(c * 1000 + 0.5)
    seg = F.transform("d.segments", lambda s: F.struct(F.coalesce(s["speaker_id"], F.lit(0)).alias("speaker"), ms(F.coalesce(s["start_time"], s["start"], F.lit(0.0))).alias("start_ms"), ms(F.coalesce(s["end_time"], s["end"], F.lit(0.0))).alias("end_ms"), F.coalesce(s["text"], F.lit("")).alias("text"), F.lit(1).alias("level")))
    word = F.transform("d.words", lambda w: F.struct(F.lit(0).alias("speaker"), ms(F.coalesce(w["start"], F.lit(0.0))).alias("start_ms"), ms(F.coalesce(w["end"], F.lit(0.0))).alias("end_ms"), F.coalesce(w["text"], F.lit("")).alias("text"), F.lit(2).alias("level")))
    zero = F.lit(0).cast("long")
    plain = F.array(F.struct(F.lit(0).alias("speaker"), zero.alias("start_ms"), zero.alias("end_ms"), F.col("d.text").alias("text"), F.lit(3).alias("level")))
    rows = F.when(F.size("d.segments") > 0, seg).when(F.size("d.words") > 0, word).when(F.col("d.text") != "", plain)
    return d.select(key, F.posexplode(rows).alias("seg_no", "x")).select(key, "seg_no", "x.*")
