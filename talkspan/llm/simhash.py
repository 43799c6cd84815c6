"""SimHash near-duplicates: fingerprints, bit-sliced comparison within pigeonhole buckets, components.

The fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints at `radius` differing bits or fewer agree
on at least BLOCKS - radius whole blocks, so a table for each such choice of blocks holds every linked pair in a
common bucket: the search is exact. Buckets of more than `tile` fingerprints are dealt into tiles, and each pair of
tiles is one group of bounded size. Within a group the fingerprints' bit planes stand vertically, a carry-save
counter per pair is updated one plane at a time, and a block is abandoned once all its counters exceed the radius.
A group returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspan.llm.common import components, map_arrow, stored

BITS = 64
#: Tables ask for two whole blocks, 21 bits or more: few fingerprints share them by chance even among 10^9.
SHARED_BLOCKS = 2
#: Shingles whose bits are counted at a time; bounds memory for long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the words of text with A-Z lower-cased; 0 if it has none. Repeated shingles count again."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle_words, len(words))
    begin, end = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begin), CHUNK):
        spans = zip(begin[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(begin), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits): a row for each row of docs. A null text has fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, fp long")


def tables(radius: int) -> list[int]:
    """Masks of the bits that a table's buckets share."""
    blocks = radius + SHARED_BLOCKS
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), SHARED_BLOCKS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """BITS rows of packed 64-bit words: row p has bit p of every fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    width = -(-len(fps) // 64) * 64
    full = np.zeros((BITS, width), np.uint8)
    full[:, : len(fps)] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def exceeding(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray | None:
    """For each query a row of packed bits: 1 where the distance exceeds radius. None once all of them do."""
    counters = max(radius.bit_length(), 1)
    shape = (len(queries), planes.shape[1])
    count = [np.zeros(shape, np.uint64) for _ in range(counters)]
    over = np.zeros(shape, np.uint64)
    flip = np.uint64(0) - ((queries[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1))
    for p in range(BITS):
        carry = planes[p][None, :] ^ flip[:, p][:, None]
        for c in count:
            c ^= carry
            carry &= ~c  # a carry leaves this digit where it was 1 and is now 0
        over |= carry
        if p % 16 == 15:
            beyond = over | _greater(count, radius)
            if not (~beyond).any():
                return None
    return beyond


def _greater(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counter exceeds radius, digit by digit from the highest."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more = more | (same & count[k])
            same = same & ~count[k]
    return more


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, for links a-b among 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jump := label[label], label):
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def group_links(fps: np.ndarray, radius: int, queries_at_once: int = 64) -> np.ndarray:
    """Labels as of forest() for the links among distinct fingerprints."""
    label = np.arange(len(fps))
    if len(fps) <= 48:  # few: the pairs' differences stand side by side as one block
        a, b = np.triu_indices(len(fps), 1)
        beyond = exceeding(bit_planes(fps[a] ^ fps[b]), np.zeros(1, np.uint64), radius)
        if beyond is None:
            return label
        near = np.unpackbits(beyond.view(np.uint8), bitorder="little")[: len(a)] == 0
        return forest(len(fps), a[near], b[near])
    planes = bit_planes(fps)
    for at in range(0, len(fps), queries_at_once):
        beyond = exceeding(planes, fps[at : at + queries_at_once], radius)
        if beyond is None:
            continue
        near = np.unpackbits(beyond.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)] == 0
        q, v = np.nonzero(near)
        keep = q + at > v
        a, b = np.concatenate((q[keep] + at, np.arange(len(fps)))), np.concatenate((v[keep], label))
        label = forest(len(fps), a, b)
    return label


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions of many groups of the same few members, compared in one block of pairs."""
    out_a, out_b = [], []
    for n in np.unique(sizes):
        if n < 2:
            continue
        first = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        per = max(1, (1 << 18) // len(i))
        for at in range(0, len(first), per):
            a = (first[at : at + per, None] + i).ravel()
            b = (first[at : at + per, None] + j).ravel()
            beyond = exceeding(bit_planes(fps[a] ^ fps[b]), np.zeros(1, np.uint64), radius)
            if beyond is not None:
                near = np.unpackbits(beyond.view(np.uint8), bitorder="little")[: len(a)] == 0
                out_a.append(a[near])
                out_b.append(b[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _bucket_links(radius: int):
    """Streams sorted rows (key columns, fp) and returns links; a group may lie across batches."""

    def settle(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        cut = np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1
        starts = np.concatenate(([0], cut))
        sizes = np.diff(np.concatenate((starts, [len(fps)])))
        few = sizes <= 48
        a, b = _small_groups(fps, starts[few], sizes[few], radius)
        out_a, out_b = [fps[a]], [fps[b]]
        for s, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
            label = group_links(fps[s : s + n], radius)
            linked = label != np.arange(n)
            out_a.append(fps[s : s + n][linked])
            out_b.append(fps[s : s + n][label[linked]])
        arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            f = batch.column(4).to_numpy().astype(np.int64).view(np.uint64)
            k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
            if not len(k):
                continue
            last = int(np.nonzero((k != k[-1]).any(1))[0][-1] + 1) if (k != k[-1]).any() else 0
            if last:
                yield settle(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
        if len(held_k):
            yield settle(held_k, held_f)

    return go


def links(distinct_fps: DataFrame, radius: int = 4, tile: int = 2048) -> DataFrame:
    """a long, b long: links (a forest within each group) among distinct fingerprints `fp`."""
    masks = tables(radius)
    bucket: Column = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    rows = distinct_fps.select("fp", F.explode(bucket).alias("x")).select("fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m"))
    tiled = (
        rows.join(sizes, ["t", "k"])
        .withColumn("m", F.ceil(F.col("n") / tile))
        .withColumn("own", own)
        .withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        .select("t", "k", F.least("own", "u").alias("i"), F.greatest("own", "u").alias("j"), "fp")
    )
    parts = tiled.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return parts.mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4, tile: int = 2048) -> DataFrame:
    """doc_id, fp long, component_id long (the smallest doc_id reachable): a row for each row of docs.

    Empty, null and blank texts have fingerprint 0 and link as any other. Rows with a null id get a fingerprint and
    their component's smallest id (null if no member has one) and can join components. Repeated rows stay repeated.
    An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle_words))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = stored(links(classes.select("fp"), radius, tile))
    roots = components(found).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")
