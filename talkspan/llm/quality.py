"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed words.

Grades 0..K-1 share one weight per hashed feature; ordered thresholds cut the score:
P(grade <= k) = logistic(threshold_k - score). Features are binary: words without symbols at their ends, their first
letters, the symbols themselves, words in capitals, and classes of how often words repeat. The model is fitted on a bounded sample of rated documents; scoring reads every
document whole.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspan.llm.common import stored

#: Rated documents fitted on, at most; they are chosen by a hash of their id.
MAX_RATED = 12_000
BITS = 20
#: First bytes of longer words that make features of their own.
PREFIXES = (4, 5, 6)
#: Probability of the top grade from which documents are kept.
LEAST_TAIL = 0.75
#: Features in fewer rated documents have no weight. Nor have those whose documents' mean grade differs from the mean of
#: all by less than EFFECT grades, or by less than SCREEN * sqrt(2 ln m) standard errors, what chance alone reaches when m
#: features are compared: words that say little would add up to noise in long texts.
MIN_DOCS, SCREEN, EFFECT = 4, 1.0, 0.3
_WORD = re.compile(rb"^([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)(.*?)([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)$", re.S)
#: Features of tokens a worker has seen, of so many at most.
HELD_TOKENS = 50_000
_KNOWN: dict[bytes, tuple[int, ...]] = {}


def _features(token: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    before, word, after = _WORD.match(token).groups()
    low = word.lower()
    found = [zlib.crc32(low) & mask] if word else []
    found += [zlib.crc32(b"\0^" + low[:n]) & mask for n in PREFIXES if len(low) > n]
    found += [zlib.crc32(b"\0<" + before) & mask] if before else []
    found += [zlib.crc32(b"\0>" + after) & mask] if after else []
    if len(after) > 1 and after[0] == after[-1]:
        found.append(zlib.crc32(b"\0repeated mark") & mask)
    if not word:
        found.append(zlib.crc32(b"\0mark alone") & mask)
    if len(word) > 2 and word.isupper():
        found.append(zlib.crc32(b"\0capitals") & mask)
    return tuple(found)


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; none of a null, empty or blank one."""
    if len(_KNOWN) > HELD_TOKENS:
        _KNOWN.clear()
    tokens = (text or b"").split()
    once = set(tokens)
    out: set[int] = set()
    if len(tokens) >= 20:
        again = sum(map(operator.eq, tokens, islice(tokens, 1, None))) / len(tokens)
        mask = (1 << BITS) - 1
        out.add(zlib.crc32(b"\0again%d" % min(5, int(again * 20))) & mask)
        out.add(zlib.crc32(b"\0distinct%d" % (10 * len(once) // len(tokens))) & mask)
    for token in once:
        if (f := _KNOWN.get(token)) is None:
            f = _KNOWN[token] = _features(token)
        out.update(f)
    return np.fromiter(sorted(out), np.int32, len(out))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32, one per feature
    thresholds: np.ndarray  # rising, one less than grades

    def score(self, text: bytes | None) -> float:
        return float(self.weights[features(text)].sum(dtype=np.float64))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a row a score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 0.01, rounds: int = 400, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by Adam on all rows of distinct features at once. Deterministic."""
    weights = np.zeros(1 << BITS, np.float32)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1)[:-1] / (len(grades) + n_grades)
    thresholds = np.log(share / (1 - share))
    if not sum(map(len, rows)):
        return OrdinalModel(weights, thresholds)
    used = np.unique(np.concatenate(rows))
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    col = number[np.concatenate(rows)]
    n_w, n_t = len(used), n_grades - 1
    x = np.zeros(n_w + n_t)  # thresholds: the first, then logs of the steps between them
    x[n_w] = thresholds[0]
    x[n_w + 1 :] = np.log(np.maximum(np.diff(thresholds), 1e-3))
    m, v = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda z: 1 / (1 + np.exp(np.clip(-z, -500, 500)))
    for t in range(1, rounds + 1):
        theta = x[n_w] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_w + 1 :]))))
        s = np.bincount(doc, x[col], minlength=len(rows))
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = sigmoid(edge[grades + 1] - s), sigmoid(edge[grades] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (d_hi - d_lo) / len(rows)  # of the negative log-likelihood by score
        g = np.zeros_like(x)
        g[:n_w] = np.bincount(col, g_s[doc], minlength=n_w) + l2 * x[:n_w] / np.sqrt(len(rows))
        g_theta = np.array([(d_lo[grades == k + 1].sum() - d_hi[grades == k].sum()) / len(rows) for k in range(n_t)])
        g[n_w] = g_theta.sum()
        for k in range(1, n_t):
            g[n_w + k] = g_theta[k:].sum() * np.exp(x[n_w + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[used] = x[:n_w]
    return OrdinalModel(weights, x[n_w] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_w + 1 :])))))


def grade() -> Column:
    """The rating of a row of labels: 0 poor, 1 sound but toxic, 2 good. Null where quality is null."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") >= 1, F.when(toxic > 0, 1).otherwise(2))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_rated: int = MAX_RATED) -> OrdinalModel:
    """Model fitted on at most max_rated rows of `ratings` (doc_id, grade int) with a document in docs (doc_id, text).

    Ratings of null ids or grades are not used; a document rated several times counts with its lowest grade. With no
    rated document every weight is 0 and all documents get the same grade.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)  # max_rated rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(b.column(1)[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "grade", "f"])

    found = stored(rows.mapInArrow(run, "doc_id long, grade int, f array<int>").withColumn("grade", F.least("grade", F.lit(n_grades - 1))))
    used = _telling(found)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [np.intersect1d(x.values.to_numpy(), used, assume_unique=True).astype(np.int32).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["doc_id", "grade", "f"])

    got = found.mapInArrow(narrow, "doc_id long, grade int, f binary").orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(max_rated).toArrow()
    arrays = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("f")]
    return fit(arrays, got.column("grade").to_numpy(), n_grades)


def _telling(found: DataFrame) -> np.ndarray:
    """Features of `found` (grade, f) that say something about the grade: at most 2^BITS numbers, in fact a few hundred."""
    all_ = found.agg(F.count("*").alias("n"), F.avg("grade").alias("mean"), F.stddev_pop("grade").alias("sd")).first()
    if not all_["n"]:
        return np.zeros(0, np.int32)
    least = min(MIN_DOCS, max(1, all_["n"] // 50))
    seen = found.select(F.explode("f").alias("i"), "grade").groupBy("i").agg(F.count("*").alias("n"), F.avg("grade").alias("mean")).where(F.col("n") >= least)
    seen = stored(seen)
    bar = SCREEN * np.sqrt(2 * np.log(max(2, seen.count())))
    effect = F.abs(F.col("mean") - all_["mean"])
    told = seen.where((effect >= EFFECT) & (effect * F.sqrt("n") / max(all_["sd"], 1e-9) >= bar))
    return np.sort(told.select("i").toArrow().column("i").to_numpy())


def score(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade double, tail_prob double (of the top grade), keep boolean (tail_prob >= least_tail):
    a row for each row of docs. Null and empty texts have no features: the thresholds alone grade them."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 4 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*shared.value)
        for b in batches:
            tails = m.tails(np.array([m.score(b.column(1)[i].as_py()) for i in range(b.num_rows)]))
            top = tails[:, -1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1)), pa.array(top), pa.array(top >= least_tail)], ["doc_id", "expected_grade", "tail_prob", "keep"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, keep boolean")


def select(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, n_chars) whose tail probability is least_tail or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*shared.value)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            tails = m.tails(np.array([m.score(texts[i].as_py()) for i in range(b.num_rows)]))
            yield b.filter(pa.array(tails[:, -1] >= least_tail))

    return rows.mapInArrow(run, rows.schema)
