"""Near copies by Jaccard similarity of word shingles: fingerprints and MinHash bands retrieve pairs, the sets decide.

The SimHash operator's bit-sliced comparison links texts whose fingerprints (here of five-word shingles) differ in a few
bits. Those are the closest copies only: at a similarity of 0.8 about ten of 64 bits differ, and a radius that reaches
them is beyond any table of blocks. So bands retrieve the rest. Equal texts are one class. Classes that share a band of their signature meet in a bucket; a pair at the least similarity
0.8 shares none of BANDS bands of ROWS minima with probability (1 - 0.8^ROWS)^BANDS, 2 in 10^4, and closer pairs far more
rarely. First each class of a bucket is held against the bucket's smallest, so a dense bucket costs one pair a class;
then the sets of buckets whose classes are still in different components come together, a tile or two a task, and are
compared there unless their signatures rule the similarity out or the task has linked them already. Tasks give a forest
of links, never pairs. Every link is a pair of sets compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspan.llm.common import components, map_arrow, stored
from talkspan.llm.simhash import links as fingerprint_links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
#: Of 64 minima, so many agree in a pair at LEAST but once in about 10^5.
AGREE = 36
#: Shingles whose minima are taken at a time; bounds memory for long texts.
CHUNK = 1 << 13
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def row_key(text: str = "text") -> Column:
    """Tells texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's runs of `width` words with A-Z lower-cased; of the whole text if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in spans], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        x = (hashes[at : at + CHUNK, None] ^ _FLIP) * _TIMES
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    return least


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed integer."""
    held = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        held += np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * held > len(hashes), bitorder="little").view("<i8")[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signatures(texts: DataFrame) -> DataFrame:
    """doc_id, key, fp, bands array<long>, sig (low 16 bits of the minima): a row for each row of texts (doc_id, key,
    text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands, sigs, fps = [], [], []
        for t in batch.column(2).to_pylist():
            hashes = shingle_set(t)
            fps.append(fingerprint(hashes))
            s = signature(hashes)
            bands.append([xxhash.xxh64_intdigest(s[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)])
            sigs.append(s.astype("<u2").tobytes())
        flat = np.array(bands, np.uint64).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), lists, pa.array(sigs, pa.binary())], ["doc_id", "key", "fp", "bands", "sig"])

    return map_arrow(texts, run, "doc_id long, key long, fp long, bands array<long>, sig binary")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["key", "s"])

    return map_arrow(texts, run, "key long, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = pa.array([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in sides], pa.bool_())
        return batch.select(["a", "b"]).filter(keep)

    return map_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def _tile_links(least: float):
    """Streams rows (band, value, i, j, own, key, root, sig, s) sorted by the first four; links that join components of a
    group. A group of two tiles leaves pairs within a tile to that tile's own group."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        own, key, root = (t.column(c).to_numpy() for c in ("own", "key", "root"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        every, column = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        label = np.unique(root, return_inverse=True)[1]
        mark = np.zeros(len(every), np.int64)
        a, b = [], []
        for x in range(len(key) - 1):
            ok = label[x + 1 :] != label[x]
            if two:
                ok &= own[x + 1 :] != own[x]
            at = np.nonzero(ok)[0] + x + 1
            at = at[(sig[at] == sig[x]).sum(1) >= AGREE]
            if not len(at):
                continue
            mark[column[begin[x] : begin[x] + sizes[x]]] = 1
            both = np.array([mark[column[begin[y] : begin[y] + sizes[y]]].sum() for y in at.tolist()])
            mark[column[begin[x] : begin[x] + sizes[x]]] = 0
            for y in at[both >= least * (sizes[at] + sizes[x] - both)].tolist():
                if label[y] != label[x]:
                    a.append(key[x])
                    b.append(key[y])
                    label[label == label[y]] = label[x]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not held.num_rows:
                continue
            k = np.stack([held.column(c).to_numpy() for c in ("band", "value", "i", "j")], 1)
            cut = np.concatenate(([0], np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield from settle(held.slice(s, e - s))
            held = held.slice(int(cut[-1]))
        if held is not None and held.num_rows:
            yield from settle(held)

    return go


def near_duplicates(docs: DataFrame, least: float = LEAST, radius: int = 4, tile: int = 1024) -> DataFrame:
    """key long (row_key of a text), root long: the smallest key reachable by links of similarity `least` or more.

    A row for each distinct text of docs (doc_id, text) and, as `doc_id`, the smallest id that has it (null if none).
    Texts without words are alike; so are texts of fewer than five words only if their words are equal.
    """
    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
    signed = stored(_signatures(texts))
    classes = stored(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    met = classes.select("key", F.posexplode("bands").alias("band", "value"))
    sizes = met.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("key").alias("center"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.shiftright(F.xxhash64("key", F.lit(3)), 20)).alias("y")).where("n > 1")
    # bands often meet in the same classes: one bucket of each such set is enough
    buckets = stored(sizes.groupBy("n", "center", "x", "y").agg(F.min(F.struct("band", "value")).alias("m")).select("m.band", "m.value", "n", "center"))
    members = stored(met.join(buckets, ["band", "value"]))
    star = members.where("key <> center").select(F.col("center").alias("a"), F.col("key").alias("b"))
    prints = stored(classes.groupBy("fp").agg(F.min("key").alias("first")))
    alike = classes.join(prints, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    close = fingerprint_links(prints.select("fp"), radius, tile)
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_key"))
    close = close.join(of("a"), "a").join(of("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    star = stored(star.union(alike).union(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = members.select("key").union(star.select("a")).union(star.select("b")).distinct()
    # copies shrink to one a map task before they meet; `min`, unlike `first`, lets filters on the key through
    sets = stored(_sets(texts.groupBy("key").agg(F.min("text").alias("text")).join(wanted, "key", "left_semi")))
    links = stored(_verified(star, sets, least))
    roots = stored(components(links))
    rooted = members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    unsettled = rooted.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "value")
    tiles = F.ceil(F.col("n") / tile)
    dealt = (
        rooted.join(unsettled, ["band", "value"])
        .join(classes.select("key", "sig"), "key")
        .join(sets, "key")
        .withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), tiles))
        .withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        .select("band", "value", F.least("own", "u").alias("i"), F.greatest("own", "u").alias("j"), "own", "key", "root", "sig", "s")
    )
    parts = dealt.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j")
    more = stored(parts.mapInArrow(_tile_links(least), "a long, b long"))
    found = components(links.union(more)).select(F.col("node").alias("key"), "root")
    return classes.select("key", "doc_id").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
