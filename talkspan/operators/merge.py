"""Merging of neighbouring intervals. All work over windows of an item; an item's order is its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def runs(df: DataFrame, keys: list[str], order: list, of: str, name: str = "run") -> DataFrame:
    """Numbers runs of equal `of`; a null is equal to a null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(F.struct(F.col(of))).over(w).isNull() | ~F.lag(of).over(w).eqNullSafe(F.col(of)), 1).otherwise(0)
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(w)).drop("_new")


def islands(df: DataFrame, keys: list[str], order: list, apart: Column, name: str = "island") -> DataFrame:
    """Numbers islands: a row begins one where `apart` holds. apart may use `_reach`, the greatest end_ms before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_reach", F.max("end_ms").over(w.rowsBetween(*BEFORE)))
    df = df.withColumn("_new", F.when(F.col("_reach").isNull() | apart, 1).otherwise(0))
    return df.withColumn(name, F.sum("_new").over(w)).drop("_new", "_reach")


def gap_merge(turns: DataFrame, keys: list[str], gap: int | None, ordinal: str = "turn_no", sort: bool = True, strict: bool = False) -> DataFrame:
    """keys, start_ms, end_ms, speaker, n: neighbours of one speaker merge when the next starts at most `gap` after
    the furthest end so far (less than that if strict; whatever the distance if gap is None). Another speaker's turn
    between them keeps them apart. sort: by start and speaker; else by the ordinal, and a merged turn starts where
    its first one does. Null starts or ends never merge and speakers that are null count as equal."""
    order = ["start_ms", "speaker", ordinal] if sort else [ordinal]
    rows = runs(turns, keys, order, "speaker")
    distance = F.col("start_ms") - F.col("_reach")
    apart = F.lit(False) if gap is None else F.coalesce(distance >= gap if strict else distance > gap, F.lit(True))
    rows = islands(rows, [*keys, "run"], order, apart)
    start = F.min("start_ms") if sort else F.min_by("start_ms", ordinal)
    return rows.groupBy(*keys, "run", "island").agg(start.alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"), F.count("*").alias("n")).drop("run", "island")


def virtual_turns(turns: DataFrame, keys: list[str], gap: int = 2000, ordinal: str = "turn_no") -> DataFrame:
    """keys, speaker, start_ms, end_ms, n: each speaker's own turns merge across the others' when less than gap apart."""
    apart = F.col("start_ms") - F.col("_reach") >= gap
    rows = islands(turns, [*keys, "speaker"], ["start_ms", ordinal], apart)
    return rows.groupBy(*keys, "speaker", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("island")


def fragment_zones(turns: DataFrame, keys: list[str], short_ms: int = 500, least: int = 3, ordinal: str = "turn_no") -> DataFrame:
    """keys, start_ms, end_ms, speaker, n: a run of `least` or more turns that are each shorter than short_ms becomes
    one turn, from the first's start to the last's end, of the speaker with the longest sum (the lower at a tie)."""
    order = ["start_ms", ordinal]
    w = Window.partitionBy(*keys, "run")
    rows = turns.withColumn("short", F.col("end_ms") - F.col("start_ms") < short_ms)
    rows = runs(rows, keys, order, "short").withColumn("size", F.count("*").over(w))
    rows = rows.withColumn("zone", F.col("short") & (F.col("size") >= least))
    zone = rows.where("zone")
    held = zone.groupBy(*keys, "run", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("held"))
    pick = F.row_number().over(w.orderBy(F.desc("held"), "speaker"))
    top = held.withColumn("_r", pick).where("_r = 1").select(*keys, "run", "speaker")
    last = F.max_by("end_ms", F.struct(*order))
    first = F.min_by("start_ms", F.struct(*order))
    merged = zone.groupBy(*keys, "run").agg(first.alias("start_ms"), last.alias("end_ms"), F.count("*").alias("n")).join(top, [*keys, "run"])
    columns = [*keys, "start_ms", "end_ms", "speaker", "n"]
    return merged.select(*columns).unionByName(rows.where("not zone").select(*keys, "start_ms", "end_ms", "speaker", F.lit(1).cast("long").alias("n")))


def midpoint_cut(turns: DataFrame, keys: list[str], ordinal: str = "turn_no") -> DataFrame:
    """keys, ordinal, start_ms, end_ms, speaker: where a turn reaches into the next, both end at the middle."""
    w = Window.partitionBy(*keys).orderBy("start_ms", ordinal)
    middle = lambda a, b: F.floor((a + b) / 2)
    nxt, prev = F.lead("start_ms").over(w), F.lag("end_ms").over(w)
    end = F.when(F.col("end_ms") > nxt, middle(F.col("end_ms"), nxt)).otherwise(F.col("end_ms"))
    start = F.when(prev > F.col("start_ms"), middle(prev, F.col("start_ms"))).otherwise(F.col("start_ms"))
    return turns.select(*keys, ordinal, start.alias("start_ms"), end.alias("end_ms"), "speaker")


def blocks(turns: DataFrame, keys: list[str], ordinal: str = "turn_no") -> DataFrame:
    """Adds block, block_first, block_last: the run of turns of one speaker, and the ordinals it spans."""
    rows = runs(turns, keys, [ordinal], "speaker", "block")
    w = Window.partitionBy(*keys, "block")
    return rows.withColumn("block_first", F.min(ordinal).over(w)).withColumn("block_last", F.max(ordinal).over(w))


def rank_speakers(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, speaker, held_ms, rank: speakers of an item by their summed time, the longest as 0 (ties: the lower)."""
    held = turns.groupBy(*keys, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("held_ms"))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("held_ms"), "speaker")) - 1)


def first_seen(rows: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """keys, label, seen: labels of an item numbered from 0 by their first row."""
    first = rows.groupBy(*keys, label).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("seen", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")
