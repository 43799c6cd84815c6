"""Streams of samples to frames, of probabilities with carried state, and of events to sessions.

State is kept per item: the samples that no complete frame has used yet, and where they begin. Streams and their
batch twins agree; what comes after an item's end marker is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspan.operators.signal import FrameOptions, first_sample, frame_count, mirrored

FRAME = "item_id long, frame_no long, first_sample long, frame array<double>, last boolean"


class Framer:
    """Emits every complete frame of what it has been given; at the end also those that reach beyond it. Frames are
    read once: the buffer holds what later frames need, and reading a frame that is gone raises."""

    def __init__(self, options: FrameOptions, start: int = 0, emitted: int = 0, total: int = 0, buffer: np.ndarray | None = None, ended: bool = False):
        self.o, self.start, self.emitted, self.total, self.ended = options, start, emitted, total, ended
        self.buffer = np.zeros(0) if buffer is None else np.asarray(buffer, float)

    def accept(self, x: np.ndarray, end: bool = False) -> list[tuple[int, int, np.ndarray, bool]]:
        """(number, first sample, samples, whether the last of all) of the new frames. The last
        one is marked only if it comes out with the end."""
        if self.ended:
            return []
        self.buffer = np.concatenate((self.buffer, x))
        self.total += len(x)
        self.ended = end
        ready = frame_count(self.total, self.o, flush=end)
        out = []
        for n in range(self.emitted, ready):
            first = first_sample(n, self.o)
            at = mirrored(first + np.arange(self.o.length), self.total) - self.start
            if (at < 0).any():
                raise IndexError(f"frame {n} is no longer held")
            out.append((n, first, self.buffer[at], end and n + 1 == ready))
        self.emitted = max(self.emitted, ready)
        # a frame at the end may be mirrored: keep a frame's length more than the next one's first sample asks for
        keep = max(self.start, min(self.total, first_sample(self.emitted, self.o)) - self.o.length)
        self.buffer, self.start = self.buffer[keep - self.start :], keep
        return out


def online_frames(samples: DataFrame, options: FrameOptions) -> DataFrame:
    """Frames of a stream of (item_id long, seq long, samples array<double>, end boolean) rows, as they are complete.
    Rows of an item within one batch are taken by seq; an item must send its rows in order over batches."""
    values = options.as_dict()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        o = FrameOptions.from_dict(values)
        held = state.get if state.exists else (0, 0, 0, [], False)
        framer = Framer(o, *held[:3], np.array(held[3]), held[4])
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for x, end in zip(rows["samples"], rows["end"], strict=True):
            out += framer.accept(np.asarray(x, float), bool(end))
        state.update((framer.start, framer.emitted, framer.total, framer.buffer.tolist(), framer.ended))
        if out:
            yield pd.DataFrame({"item_id": key[0], "frame_no": [f[0] for f in out], "first_sample": [f[1] for f in out], "frame": [f[2] for f in out], "last": [f[3] for f in out]})

    schema = "start long, emitted long, total long, buffer array<double>, ended boolean"
    return samples.groupBy("item_id").applyInPandasWithState(run, FRAME, schema, "append", "NoTimeout")


def online_scores(windows: DataFrame, start: Callable[[], list[float]], step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]]) -> DataFrame:
    """item_id, seq, prob of a stream of (item_id long, seq long, samples array<double>): a recurrent scorer whose
    state vector is carried over batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        carried = np.array(state.get[0] if state.exists else start(), float)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for x in rows["samples"]:
            carried, p = step(carried, np.asarray(x, float))
            out.append(float(p))
        state.update((np.asarray(carried, float).tolist(),))
        yield pd.DataFrame({"item_id": key[0], "seq": rows["seq"].to_numpy(), "prob": out})

    return windows.groupBy("item_id").applyInPandasWithState(run, "item_id long, seq long, prob double", "carried array<double>", "append", "NoTimeout")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """key, first_ms, last_ms, n: sessions of a stream (key, ts) not more than gap apart; those the watermark has
    passed come out, and later events are dropped."""
    g = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s"))
    return g.agg(F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"), F.count("*").alias("n")).drop("s")


def tumbling(events: DataFrame, key: str, size: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """key, start_ms, n: counts by tumbling windows, or sliding ones."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(key, w.alias("w"))
    return g.agg(F.count("*").alias("n")).select(key, F.unix_millis("w.start").alias("start_ms"), "n")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now, into a table in folder, and reads that."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
