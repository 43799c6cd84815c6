"""Shared folder, stored intermediate tables, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What words are split at: space and the control characters from tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Only a local session may go without that
    setting; it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="talkspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/talkspan-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is computed once.
    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def map_arrow(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """run on each Arrow batch; no state passes between batches."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = run(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(go, schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long): node, root (the smallest node reachable).

    Large-star and small-star steps alternate until the edges no longer change. Each step is a `min` per node,
    which partial aggregation shrinks before the shuffle, and a join of two stored tables: adaptive execution splits
    a skewed join only if both sides come straight from a shuffle, not from an aggregate above it. So a hub with a
    third of all edges is no hot task. Loops, repeated edges and nulls are dropped; no edges give no rows.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    state = _digest(now)
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.union(now.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b").distinct())
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = stored(small.union(low.toDF("a", "b")).distinct())
        for table in (now, least, large, low):
            dropped(table)
        now, before, state = then, state, _digest(then)
        if state == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _digest(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())
