"""Audio and array files: WAV, raw f32, NPY and NPZ. Files are read by Spark, from any store it can reach."""

from __future__ import annotations

import io
import os
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

#: WAV files above this size are left to other decoders.
LARGEST = 220 << 20


def parse_wav(raw: bytes, rate: int = 16_000) -> tuple[np.ndarray, int] | None:
    """Mono samples in -1..1 and the channels of 16-bit PCM at `rate`; None for anything else."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE" or len(raw) > LARGEST:
        return None
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            if form is None or form[0] != 1 or form[2] != rate or form[5] != 16 or form[1] < 1:
                return None
            n = len(body) // (2 * form[1])
            x = np.frombuffer(body[: n * 2 * form[1]], "<i2").reshape(n, form[1])
            return x.mean(1) / 32768.0, form[1]
        at += 8 + size + size % 2
    return None


def wav_bytes(x: np.ndarray, rate: int = 16_000, channels: int = 1) -> bytes:
    """A WAV file of 16-bit samples, the same in each channel."""
    data = np.repeat(np.clip(np.round(np.asarray(x) * 32768), -32768, 32767).astype("<i2")[:, None], channels, axis=1).tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16, b"data", len(data))
    return head + data


def read_audio(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """path, decoder ("wav", "f32" or null), sample_rate, sample_count, channels, samples: a row a file. Files named
    *.f32 are raw little-endian floats; others are WAV, with null samples if they are not of the accepted kind."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = c.as_py()
                got = (np.frombuffer(raw[: len(raw) // 4 * 4], "<f4"), 1) if p.endswith(".f32") else parse_wav(raw, rate)
                kind = None if got is None else "f32" if p.endswith(".f32") else "wav"
                rows.append({"path": p, "decoder": kind, "sample_rate": rate, "sample_count": 0 if got is None else len(got[0]), "channels": 0 if got is None else got[1], "samples": None if got is None else got[0].astype(np.float32)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("decoder", pa.string()), ("sample_rate", pa.int32()), ("sample_count", pa.int64()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32()))]))

    return files.mapInArrow(run, "path string, decoder string, sample_rate int, sample_count long, channels int, samples array<float>")


def blocks(audio: DataFrame, key: str, size: int = 1 << 20) -> DataFrame:
    """key, block_no, samples: arrays in blocks of `size`."""
    n = F.greatest(F.lit(0), F.ceil(F.size("samples") / size).cast("int") - 1)
    r = audio.where(F.size("samples") > 0).withColumn("block_no", F.explode(F.sequence(F.lit(0), n)))
    return r.select(key, "block_no", F.slice("samples", F.col("block_no") * size + 1, size).alias("samples"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Range(InputPartition):
    def __init__(self, path: str, block: int):
        super().__init__(block)
        self.path, self.block = path, block


class _PcmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("blocksize", 1 << 20))
        self.first, self.last = int(options.get("firstblock", 0)), int(options.get("lastblock", 1 << 40))

    def partitions(self) -> list[InputPartition]:
        store, at = _store(self.path)
        info = store.get_file_info(at)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        n = -(-(info.size // 4) // self.size)
        return [_Range(self.path, b) for b in range(max(0, self.first), min(n, self.last + 1))]

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, at = _store(partition.path)
        with store.open_input_file(at) as f:
            raw = f.read_at(self.size * 4, partition.block * self.size * 4)
        yield partition.block, np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").tolist()


class PcmSource(DataSource):
    """format "talkspan_pcm": block_no, samples of one raw f32 file, by the URI of a store that all executors reach
    or a path that they mount. Each block is a partition and reads its own bytes; options firstBlock and lastBlock bound
    what is read."""

    @classmethod
    def name(cls) -> str:
        return "talkspan_pcm"

    def schema(self) -> str:
        return "block_no int, samples array<float>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PcmReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcmSource)


def _array(raw: bytes) -> tuple[list[int], list[float]]:
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.dtype not in (np.dtype("<f4"), np.dtype("<f8")) or np.isfortran(a):
        raise ValueError("only little-endian float arrays in C order are supported")
    return list(a.shape), a.astype(float).ravel().tolist()


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, name, shape, data: a row an array of NPY files and of the members of NPZ files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = c.as_py()
                if raw[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        parts = [(os.path.basename(n).removesuffix(".npy"), z.read(n)) for n in z.namelist()]
                else:
                    parts = [(os.path.basename(p).removesuffix(".npy"), raw)]
                for name, content in parts:
                    shape, data = _array(content)
                    rows.append({"path": p, "name": name, "shape": shape, "data": data})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float64()))]))

    return files.mapInArrow(run, "path string, name string, shape array<int>, data array<double>")
