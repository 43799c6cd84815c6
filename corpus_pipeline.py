"""A corpus pipeline of five stages over `documents`, each with one operator of talkspan.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.llm import linededup, mixing, pieces, quality, shingles
from talkspan.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is high enough stay."""
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", quality.grade().alias("grade"))
    return quality.select(docs, quality.train(docs, ratings))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only; n_chars follows the text."""
    return linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))


def _row() -> list[Column]:
    """no_id, id, key: rows of docs with a `key`, by columns that are never null."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("key")]


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles overlap by 0.8 or more, one row stays: that of the smallest
    doc_id, of the smallest text key among its texts. Null ids come last. Documents without words are one group."""
    found = shingles.near_duplicates(docs)
    keep = found.groupBy("root").agg(F.min(F.struct(*_row())).alias("f")).select("f.*")
    rows = docs.select(*COLUMNS, shingles.row_key().alias("key")).select(*COLUMNS, *_row()).dropDuplicates(["no_id", "id", "key"])
    return rows.join(keep, ["no_id", "id", "key"], "left_semi").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the copies of a document are rows of its doc_id.

    Decisions meet rows by id and a hash of all columns, so null and repeated ids are no hot key; equal rows are one
    row with the sum of their copies.
    """
    parts = ("text", "lang", "source", "n_chars")
    keyed = docs.select(*COLUMNS, F.xxhash64(*parts, *[F.col(c).isNull() for c in parts]).alias("key"))  # nulls alone leave a hash as it is
    taken = mixing.mix(keyed, carry=("key",)).select(*_row(), F.col("copies").cast("int").alias("copies"))
    taken = taken.groupBy("no_id", "id", "key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    rows = keyed.select(*COLUMNS, *_row()).dropDuplicates(["no_id", "id", "key"])
    return rows.join(taken, ["no_id", "id", "key"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    return pieces.encode(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage), ("mix", mix_stage), ("pieces", pieces_stage)]

ORACLE_SQL = None  # a fitted classifier, fingerprints and token ids are beyond SQL: tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n + 1 == len(STAGES):
            return out
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
