"""Text, JSON and manifest files, and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.functions import text

ITEM = "id string, display_name string, original_name string, status string, source_file string, source_bytes long, created_ms long, updated_ms long, schema_version int"
MEDIA = ("wav", "mp3", "m4a", "aac", "ogg", "opus", "flac", "mp4", "mkv", "webm", "3gp", "amr")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, line of one text file, by position from 0. The file is read whole: it is a list, not a corpus."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def token_table(rows: DataFrame) -> DataFrame:
    """piece, id of lines "piece id": the last field is the id; lines without one are skipped."""
    m = r"^(.*)\s+(-?\d+)\s*$"
    out = rows.select(F.regexp_extract("line", m, 1).alias("piece"), F.regexp_extract("line", m, 2).try_cast("int").alias("id"))
    return out.where("id is not null and piece <> ''")


def piece_scores(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """piece, score, id, longest of lines "piece<TAB>score" whose piece has an id in tokens."""
    m = r"^(.*)\t([^\t]*)$"
    p = rows.select(F.regexp_extract("line", m, 1).alias("piece"), F.regexp_extract("line", m, 2).try_cast("double").alias("score")).where("score is not null")
    return p.join(tokens, "piece").withColumn("longest", F.max(F.length("piece")).over(Window.partitionBy()))


def vocabulary(rows: DataFrame) -> DataFrame:
    """id, token: the lines that are not empty, numbered from 0. One list, one window."""
    kept = rows.where(F.trim("line") != "")
    return kept.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("id"), F.trim("line").alias("token"))


def phrases(rows: DataFrame, default: float = 1.5, most: int = 1000) -> DataFrame:
    """pos, phrase, score of a phrase list; comments and blanks are skipped; the first `most` count, as of the list's
    own limit."""
    phrase, score = text.phrase_score(F.col("line"), default)
    return rows.where(text.is_phrase_line(F.col("line"))).select("pos", phrase.alias("phrase"), score.alias("score")).orderBy("pos").limit(most)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Items of metadata JSON files, one a file; what cannot be read or has no source is skipped, and fields have
    defaults."""
    d = spark.read.schema(ITEM + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return d.where("id is not null and source_file is not null").select(
        "id", F.coalesce("display_name", "original_name", F.lit("untitled")).alias("display_name"), F.coalesce("original_name", F.lit("")).alias("original_name"),
        F.coalesce("status", F.lit("processing")).alias("status"), "source_file", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("source_bytes", "created_ms", "updated_ms")],
    )


def media_only(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(text.extension(F.col(path)).isin(*MEDIA))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a file of a JSON manifest {"files": [...]}."""
    fields = "struct<id:string,target_path:string,repo:string,path:string,bytes:bigint,sha256:string,license:string,revision:string>"
    d = spark.read.schema(f"files array<{fields}>").option("multiLine", True).json(path)
    return d.select(F.explode("files").alias("f")).select("f.*")


def save_results(results: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """key, json as text, a folder a key; a rewrite replaces the keys it holds only."""
    writer = results.select(key, "json").write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key).format("text").save(path)


def read_results(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.text(path, wholetext=False).select(F.col(key), F.col("value").alias("json"))


def save_stage(df: DataFrame, folder: str, item: str, stage: str) -> None:
    """A stage's table, to resume from."""
    df.write.mode("overwrite").parquet(f"{folder}/{item}/{stage}")


def read_stage(spark: SparkSession, folder: str, item: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{item}/{stage}")


def phrase_lines(rows: DataFrame) -> DataFrame:
    """line of phrase, score: the text form that phrases() reads."""
    return rows.select("pos", F.concat("phrase", F.lit(" :"), text.score_text(F.col("score"))).alias("line"))
