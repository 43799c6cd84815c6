"""The library of items: search, status, deletion, joins with files and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspan.functions import text

STATUSES = ("processing", "complete", "error", "cancelled")


def search(items: DataFrame, wanted: str, columns: tuple[str, ...] = ("display_name", "original_name", "status")) -> DataFrame:
    """Items whose joined columns hold the words wanted, whatever the case; all for a blank search."""
    key = wanted.strip().lower()
    return items.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(key))) if key else items


def newest(items: DataFrame, n: int | None = None) -> DataFrame:
    """By falling updated_ms, then id."""
    rows = items.orderBy(F.desc("updated_ms"), "id")
    return rows if n is None else rows.limit(n)


def unfinished(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items in process without a result (results: id)."""
    return items.where("status = 'processing'").join(results.select("id"), "id", "left_anti")


def set_status(items: DataFrame, changes: DataFrame) -> DataFrame:
    """items with status and updated_ms of changes (id, status, updated_ms); unknown ids change nothing, and of
    several changes of one item the last counts."""
    last = changes.groupBy("id").agg(F.max(F.struct("updated_ms", "status")).alias("c"))
    rows = items.join(last, "id", "left")
    return rows.withColumn("status", F.coalesce("c.status", "status")).withColumn("updated_ms", F.coalesce("c.updated_ms", "updated_ms")).select(items.columns)


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti")


def selected(choice: DataFrame, items: DataFrame) -> DataFrame:
    """Chosen ids that still exist."""
    return choice.join(items.select("id"), "id", "left_semi")


def toggle(choice: DataFrame, ids: DataFrame, on: bool) -> DataFrame:
    """choice with ids added, or taken away."""
    return choice.union(ids).distinct() if on else choice.join(ids, "id", "left_anti")


def missing(required: DataFrame, present: DataFrame, on: str) -> DataFrame:
    return required.join(present.select(on), on, "left_anti")


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state of each manifest row (path, bytes, sha256) by files (path, content binary): missing, wrong size,
    wrong hash, or ok. Sizes of 0 are not checked, nor are null hashes."""
    f = files.select("path", F.length("content").alias("n"), F.sha2("content", 256).alias("h"))
    state = F.when(F.col("n").isNull(), "missing").when((F.col("bytes") > 0) & (F.col("n") != F.col("bytes")), "wrong size").when(F.col("h") != F.lower("sha256"), "wrong hash").otherwise("ok")
    return manifest.join(f, "path", "left").select("path", state.alias("state"))


def imported(sources: DataFrame, now_ms: Column) -> DataFrame:
    """New items of sources (name, bytes): a random id, in process, created and updated now."""
    return sources.select(
        F.expr("uuid()").alias("id"), text.display_name(text.base_name(F.col("name"))).alias("display_name"), F.col("name").alias("original_name"),
        F.lit("processing").alias("status"), F.col("bytes").alias("source_bytes"), now_ms.alias("created_ms"), now_ms.alias("updated_ms"),
    )


def with_speakers(rows: DataFrame, speakers: DataFrame, palette: tuple[str, ...]) -> DataFrame:
    """rows with the name and colour of their speaker, by speakers (speaker, name, color) or else by number."""
    default = F.element_at(F.array(*map(F.lit, palette)), (F.pmod(F.col("speaker"), F.lit(len(palette))) + 1).cast("int"))
    out = rows.join(speakers, "speaker", "left")
    return out.withColumn("name", F.coalesce("name", text.speaker_label(F.col("speaker")))).withColumn("color", F.coalesce("color", default))
