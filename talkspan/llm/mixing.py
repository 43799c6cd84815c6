"""Mixing of sources to target weights, with DataFrame functions only.

Documents get a hash-random key. Key ranges split each source evenly however large it is; sums per range give each
range's offset, a running sum within the range gives each document's prefix of words, and the source's budget cuts
there. Budgets above a source's size take whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspan.llm.common import SPACE, stored

#: Fixed weights, by the sources' order.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: of `sources` (source, source_size), a row a source.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; a target stops at
    `most` times its source's size and the excess goes to the others by weight, until none is above. In closed form:
    with sources by rising most * size / weight, the level is the first at which what is left, over the weight left,
    lies below the next source's ratio. Works on one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", rank).withColumn("w", w.cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (total * F.lit(float(share)) - capped * F.lit(float(most))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level)
    holds = F.col("level") * F.col("w") <= F.lit(float(most)) * F.col("source_size")
    final = F.min(F.when(holds, F.struct(F.col("source_size") / F.col("w"), F.col("rank"), F.col("level")))).over(every)
    chosen = leveled.withColumn("final", final["level"])
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("final") * F.col("w"), F.lit(float(most)) * F.col("source_size")))
    return chosen.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", range_rows: int = 4096, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: a row for each row of docs (doc_id, text, source).

    size: words of the text (null: 0). taken: words the mix takes of the document, repeats counted; within a source
    they add up to the target less a fraction of a word, and the document at the cut gives part of its words.
    copies: whole documents to emit: full epochs, plus one if at least half of the document lies before the cut.
    The order is by md5 of seed, doc_id and the text's own md5, then doc_id and size, so reruns agree; rows that agree
    in all are alike. Null and repeated ids are spread as any others. Ranges of keys grow in number with the documents.
    Columns of docs named in `carry` order rows further and come last, so that decisions find their rows.
    Sources of size 0 have target 0 and take nothing (copies 0 would lose empty texts: they are as many as epochs).
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sized = stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), key.alias("md5"), *carry))
    # a source that holds all rows has `range_rows` or fewer of them in a range
    digits = max(2, math.ceil(math.log(max(1, sized.count() / range_rows), 16)))
    keyed = sized.withColumn("range", F.substring("md5", 1, digits))
    ranges = stored(keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).select(F.col("source").alias("s"), F.col("range").alias("r"), "offset")
    aim = targets(sources, weights, share, most).select(F.col("source").alias("s2"), "source_size", "target")
    plan = offsets.join(aim, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    within = Window.partitionBy("source", "range").orderBy("md5", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    prefix = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = prefix.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs.cast("long"))
    left = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("offset") - F.col("inside")))
    rows = rows.withColumn("part", part)
    more = F.when(F.col("size") > 0, (F.col("part") * 2 >= F.col("size")).cast("long")).otherwise((left > F.col("offset") + F.col("inside")).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), (F.col("epochs") + more).alias("copies"), *carry)
