"""Removal of lines that several documents share, decided on hashes alone.

A document gives one row per distinct line key (128-bit hash, document, positions). The rows are range-partitioned by
hash, document and row and sorted, so each hash's documents stream by in order and no hash is bound to one partition.
Runs that end inside a partition are decided there. Rows of a partition's first and last run, and of runs longer than
HELD, stay open; their sums by piece meet in a table of a few rows per partition, which decides them (a document that
ends one piece and begins the next counts once). The result
is a compressed keep bitmap for each document that loses lines; texts are not moved until bitmaps are applied.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkspan.llm.common import map_arrow, stored

BLANK = b" \t\n\x0b\x0c\r"
#: Rows of one run that a task holds before it leaves the run open.
HELD = 200_000
NO_ID = np.iinfo(np.int64).min


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def row_key():
    """Tells rows of the same doc_id apart; rows that agree in both are the same row, with the same decisions."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, row_key, n_lines, at array<int>: a row per document and distinct key of min_chars or more."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, doc, row, n_lines, ats = [], [], [], [], []
        ids = batch.column(0).to_pylist()
        rows = batch.column(1).to_pylist()
        texts = batch.column(2)
        for i in range(batch.num_rows):
            lines = (texts[i].as_py() or b"").split(b"\n")
            at: dict[bytes, list[int]] = {}
            for p, line in enumerate(lines):
                key = line_key(line)
                if _long_enough(key, min_chars):
                    at.setdefault(key, []).append(p)
            h.extend(xxhash.xxh3_128_digest(k) for k in at)
            ats.extend(at.values())
            doc.extend([NO_ID if ids[i] is None else ids[i]] * len(at))
            row.extend([rows[i]] * len(at))
            n_lines.extend([len(lines)] * len(at))
        h = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
        arrays = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(n_lines, pa.int32()), pa.array(ats, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc_id", "row_key", "n_lines", "at"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, "h1 long, h2 long, doc_id long, row_key long, n_lines int, at array<int>")


def _stream(min_docs: int):
    """From sorted rows: dropped rows, and open rows of runs that may go on in another partition, by piece."""

    def tell(table: pa.Table, open_: bool, piece: int = 0) -> pa.Table:
        h1, h2, doc = (table.column(i).to_numpy() for i in range(3))
        new_run = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        first = new_run | np.concatenate(([True], doc[1:] != doc[:-1]))
        if not open_:
            run = np.cumsum(new_run) - 1
            ends = np.concatenate((np.nonzero(new_run)[0][1:], [len(doc)])) - 1
            drop = (np.bincount(run, first)[run] >= min_docs) & (doc != doc[ends][run])
            keep = pa.array(drop)
            table, first = table.filter(keep), first[drop]
        table = table.append_column("first", pa.array(first.astype(np.int32)))
        return table.append_column("open", pa.array(np.full(len(first), open_))).append_column("piece", pa.array(np.full(len(first), piece)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of one run
        n_held, at_start, overflowing = 0, True, False
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            h1, h2 = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = (np.nonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[0] + 1).tolist()
            goes_on = bool(held) and held[-1].column(0)[-1].as_py() == h1[0] and held[-1].column(1)[-1].as_py() == h2[0]
            if held and not goes_on:
                piece += 1
                yield from tell(pa.concat_tables(held), at_start or overflowing, piece).to_batches()
                held, n_held, at_start, overflowing = [], 0, False, False
            if not cut:
                held.append(table)
                n_held += table.num_rows
            else:
                if held or at_start:
                    piece += 1
                    yield from tell(pa.concat_tables([*held, table.slice(0, cut[0])]), at_start or overflowing, piece).to_batches()
                    at_start, overflowing, begin = False, False, cut[0]
                else:
                    begin = 0
                if begin < cut[-1]:
                    yield from tell(table.slice(begin, cut[-1] - begin), False).to_batches()
                held, n_held = [table.slice(cut[-1])], table.num_rows - cut[-1]
            if n_held > HELD:  # all but the last row go out open
                piece += 1
                whole = pa.concat_tables(held)
                yield from tell(whole.slice(0, n_held - 1), True, piece).to_batches()
                held, n_held, overflowing = [whole.slice(n_held - 1)], 1, True
        if held:
            yield from tell(pa.concat_tables(held), True, piece + 1).to_batches()

    return go


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Of each document that loses lines: doc_id, row_key, n_lines int, n_dropped int, keep binary.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of min_chars code points or
    more found in min_docs documents or more lose their lines except in the largest doc_id holding them, which keeps
    all of its own. Documents that share a doc_id count as one; rows with a null id count as one document below all
    others (their doc_id is null in the result). keep: zlib of one bit a line, lowest bit first, 1 where it stays.
    """
    keys = stored(line_keys(docs.select("doc_id", "text"), min_chars))
    dealt = keys.repartitionByRange("h1", "h2", "doc_id", "row_key").sortWithinPartitions("h1", "h2", "doc_id", "row_key")
    schema = "h1 long, h2 long, doc_id long, row_key long, n_lines int, at array<int>, first int, open boolean, piece long"
    told = stored(dealt.mapInArrow(_stream(min_docs), schema))
    pending = told.where("open")
    # two pieces a partition, and one for each HELD rows of a longer run: bounded by the number of partitions
    parts = pending.groupBy("h1", "h2", "piece").agg(F.sum("first").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("last"))
    before = F.lag("last").over(Window.partitionBy("h1", "h2").orderBy("low", "last", "piece"))
    parts = parts.withColumn("n", F.col("n") - F.coalesce((before == F.col("low")).cast("int"), F.lit(0)))
    sums = parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)
    late = pending.join(F.broadcast(sums), ["h1", "h2"]).where("doc_id <> last")
    drops = told.where("not open").select("doc_id", "row_key", "n_lines", "at").union(late.select("doc_id", "row_key", "n_lines", "at"))
    packed = drops.groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_lines, n_dropped, keep = batch.column(2).to_pylist(), [], []
        for n, at in zip(n_lines, batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[at] = 0
            n_dropped.append(int(n - bits.sum()))
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        ids = pa.array([None if x == NO_ID else x for x in batch.column(0).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2), pa.array(n_dropped, pa.int32()), pa.array(keep, pa.binary())], ["doc_id", "row_key", "n_lines", "n_dropped", "keep"])

    return map_arrow(packed, run, "doc_id long, row_key long, n_lines int, n_dropped int, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little", count=len(lines))
    return b"\n".join([line for line, k in zip(lines, bits.tolist(), strict=True) if k])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_row"), "keep")
    return docs.withColumn("_key", row_key()).join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with the kept lines as text and their length as n_chars.
    Documents whose lines all went have an empty text; a null text stays null."""
    rows = _with_bitmaps(docs.select("doc_id", "text", "lang", "source", "n_chars"), bitmaps)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "lang", "source", "n_chars", "keep")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old, marks = batch.column(1), batch.column(5).to_pylist()
        texts = [None if (t := old[i].as_py()) is None else kept_text(t, k).decode("utf-8", "replace") for i, k in enumerate(marks)]
        n = [o if k is None else len(t) for t, k, o in zip(texts, marks, batch.column(4).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(n, pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])

    return map_arrow(rows.withColumn("n_chars", F.col("n_chars").cast("long")), run, "doc_id long, text string, lang string, source string, n_chars long")


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines long, n_dropped long, kept_sha256 string: a row for each row of docs."""
    rows = _with_bitmaps(docs.select("doc_id", "text"), bitmaps).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "keep")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, dropped, digest = [], [], []
        marks = batch.column(2).to_pylist()
        for i, mark in enumerate(marks):
            text = batch.column(1)[i].as_py() or b""
            n.append(text.count(b"\n") + 1)
            kept = kept_text(text, mark)
            bits = zlib.decompress(mark) if mark is not None else b""
            stay = n[-1] if mark is None else sum(map(int.bit_count, bits))  # bits beyond the last line are 0
            dropped.append(n[-1] - stay)
            digest.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_arrow(rows, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
