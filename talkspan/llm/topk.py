"""Exact top-k by inner product over a pivot-distance index.

Inner product becomes distance by one more coordinate: with M the largest norm, v' = (v, sqrt(M^2 - |v|^2)) and
q' = (q, 0) give |q' - v'|^2 = |q|^2 + M^2 - 2 q.v. Vectors are keyed by their nearest pivot and their distance to it,
range-partitioned and sorted by that key: a run in key order is an annulus, a run of neighbouring annuli of a pivot is a
band, stored as one row. A query first expands the band that promises most, which gives it k scores; the k-th is the
least it still needs. Then the triangle inequality, |q' - v'| >= |d(q', pivot) - d(v', pivot)|, stops the search: a query
is sent only to bands whose bound reaches its need, ties included, and there skips annuli whose bound does not. Scores
are sums of whole numbers and exact in the floating type chosen for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspan.llm.common import stored

#: Pivots, chosen from a sample of so many rows by a hash of their id and components.
PIVOTS, SAMPLE = 64, 2048
#: Vectors of an annulus; of a band at least and, up to BANDS bands in all, at most; queries of a slab.
ANNULUS, LEAST_BAND, MOST_BAND, SLAB = 256, 1024, 65536, 2048
#: No table has more bands than this and two for each pivot and partition: what every task gets to know of the index.
BANDS = 100_000
NO_ID = np.iinfo(np.int64).max


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v array<double>: floor(scale * x) of rows (vec_id, embedding) whose vector is not null and whose
    components are neither null nor infinite nor NaN; an empty vector takes part with score 0."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros, or cut, to dim components: the inner product runs over those that both vectors have."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    begin = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, : min(n, dim)] = flat[begin : begin + min(n, dim)]
        begin += n
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (x, extra) to pivots, which have the extra coordinate last."""
    full = np.concatenate((x, extra[:, None]), axis=1)
    d = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best (score falling, id rising)."""
    if scores.shape[1] > 4 * k:  # all that may be among the best, ties included
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        most = int((scores >= least[:, None]).sum(1).max())
        if most <= scores.shape[1] // 2:
            key = np.where(scores >= least[:, None], 0, 1)
            pick = np.argsort(key, axis=1, kind="stable")[:, :most]
            scores, ids = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _dtype(top: float) -> type:
    """The smallest type that holds whole numbers up to top: what vectors are moved in."""
    return next((t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max), np.float64)


def _reach(to_pivot: np.ndarray, norms: np.ndarray, most: float, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """By query and annulus (or band): no score in it is above. Widened by more than rounding may take away."""
    gap = np.maximum(0, np.maximum(to_pivot[:, pivot] - hi, lo - to_pivot[:, pivot]) - 1e-6)
    return (norms[:, None] + most * most - gap * gap) / 2 * (1 + 1e-9) + 1e-6


class _Index:
    """What every task knows: pivots, the largest norm, the type vectors are moved in, and k."""

    def __init__(self, pivots: np.ndarray, most: float, kind: type, k: int) -> None:
        self.pivots, self.most, self.kind, self.k, self.dim = pivots, most, kind, k, pivots.shape[1] - 1

    def queries(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of packed queries, their squared norms and distances to pivots."""
        q = np.frombuffer(b"".join(packed), self.kind).reshape(-1, self.dim).astype(float)
        return q, (q * q).sum(1), _distances(q, np.zeros(len(q)), self.pivots)

    def bands(self, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        """Bands of sorted rows (pivot, d, vec_id, row, packed): bounds, and annuli one after another."""

        def out(t: pa.Table) -> pa.RecordBatch:
            d, ids, rows = t.column("d").to_numpy(), t.column("vec_id").fill_null(NO_ID).to_numpy(), t.column("row").to_numpy()
            columns = [[t.column("pivot")[0].as_py()], [float(d[0])], [float(d[-1])], [len(d)], [d.tobytes()], [ids.tobytes()], [rows.tobytes()], [b"".join(t.column("packed").to_pylist())]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BAND, strict=True)], schema=_BAND)

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            pivot = held.column("pivot").to_numpy()
            cuts = np.concatenate(([0], np.nonzero(pivot[1:] != pivot[:-1])[0] + 1, [len(pivot)])).tolist()
            done = 0
            for s, e in zip(cuts, cuts[1:], strict=False):
                whole = e if e < len(pivot) else s + (e - s) // size * size
                for a in range(s, whole, size):
                    yield out(held.slice(a, min(size, whole - a)))
                done = whole
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield out(held)

    def expand(self, queries: pa.Table, band: pa.Table) -> pa.Table:
        """Cogrouped: queries (row, packed, need) and the one band they open. A row for each candidate of a query's k
        best that reaches its need, and one with b null for the number of vectors scored (in score)."""
        if not queries.num_rows or not band.num_rows:
            return _FOUND.empty_table()
        own, need = queries.column("row").to_numpy(), queries.column("need").to_numpy()
        q, norms, to_pivot = self.queries(queries.column("packed").to_pylist())
        band_row = band.slice(0, 1).to_pylist()[0]
        d, ids, rows = np.frombuffer(band_row["ds"]), np.frombuffer(band_row["ids"], np.int64), np.frombuffer(band_row["rows"], np.int64)
        v = np.frombuffer(band_row["vectors"], self.kind).reshape(len(ids), self.dim)
        start = np.arange(0, len(ids), ANNULUS)
        end = np.minimum(start + ANNULUS, len(ids))
        reach = _reach(to_pivot, norms, self.most, np.full(len(start), band_row["pivot"]), d[start], d[end - 1])
        typed = np.float32 if float(np.abs(q).max(initial=0)) * self.most * self.dim < 2**24 else float
        q, k = q.astype(typed), self.k
        top_s, top_i = np.full((len(q), k), -np.inf), np.full((len(q), k), NO_ID)
        scored = np.zeros(len(q), np.int64)
        for a in np.argsort(-reach.max(0), kind="stable").tolist():
            open_ = np.nonzero(reach[:, a] >= np.maximum(need, top_s[:, -1]))[0]
            s, e = int(start[a]), int(end[a])
            x = v[s:e].astype(typed).T
            for at in range(0, len(open_), 512):
                o = open_[at : at + 512]
                score = (q[o] @ x).astype(float)
                score[rows[None, s:e] == own[o][:, None]] = -np.inf
                scored[o] += e - s
                top_s[o], top_i[o] = best_of(np.concatenate((top_s[o], score), axis=1), np.concatenate((top_i[o], np.broadcast_to(ids[s:e], score.shape)), axis=1), k)
        r, c = np.nonzero((top_s > -np.inf) & (top_s >= need[:, None]))
        found = pa.table([pa.array(own[r]), pa.array(top_i[r, c]), pa.array(top_s[r, c])], schema=_FOUND)
        return pa.concat_tables([found, pa.table([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(scored.astype(float))], schema=_FOUND)])


_BAND = pa.schema([("pivot", pa.int32()), ("d_min", pa.float64()), ("d_max", pa.float64()), ("n", pa.int32()), ("ds", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, asked: Column, k: int = 20, pivots: int = PIVOTS, scored: bool = False) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for each row of `vectors` (vec_id, v) that meets the condition
    `asked`, the k other rows of the highest inner product; ties go to the smaller vec_id, null last.

    Rows are told apart by place, not by id: a repeated or null id is a row, a candidate and a query like any other.
    Vectors shorter than the longest count as if zeros followed. Fewer than k candidates give fewer rows; an empty
    table gives none. Components must be whole numbers; scores are exact below 2^53. With `scored` the result is
    query_id and scored long, the number of vectors the query was held against.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "v", F.coalesce(asked, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")))
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asks"), F.max(F.size("v")).alias("dim"), F.max(F.expr("aggregate(v, 0d, (a, x) -> a + x * x)")).alias("norm"), F.max(F.expr("aggregate(v, 0d, (a, x) -> greatest(a, abs(x)))")).alias("top")).first()
    kind, dim, most = _dtype(stats["top"] or 0), stats["dim"] or 0, float(np.sqrt(stats["norm"] or 0))
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE).select("row", "v").toArrow()  # a fixed number of rows
    s_rows = sample.column("row").to_numpy()
    s = _matrix(sample.column("v").combine_chunks(), dim) if len(s_rows) else np.zeros((0, dim))
    chosen = np.unique(s, axis=0)
    pivots = min(pivots, max(4, stats["n"] // LEAST_BAND))  # a band holds vectors of one pivot
    chosen = chosen[np.random.default_rng(0).permutation(len(chosen))[:pivots]] if len(chosen) else np.zeros((1, dim))
    extra = lambda x: np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))
    index = _Index(np.concatenate((chosen, extra(chosen)[:, None]), axis=1), most, kind, k)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), dim)
            d = _distances(x, extra(x), index.pivots)
            near = d.argmin(1)
            packed = [r.tobytes() for r in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(packed, pa.binary())], ["row", "vec_id", "pivot", "d", "packed"])

    size = max(LEAST_BAND, min(MOST_BAND, -(-stats["n"] // 64)), -(-stats["n"] // BANDS))
    sorted_ = rows.select("row", "vec_id", "v").mapInArrow(keyed, "row long, vec_id long, pivot int, d double, packed binary").repartitionByRange("pivot", "d", "row").sortWithinPartitions("pivot", "d", "row")
    bands = stored(sorted_.mapInArrow(lambda batches: index.bands(batches, size), "pivot int, d_min double, d_max double, n int, ds binary, ids binary, rows binary, vectors binary").withColumn("band", F.monotonically_increasing_id()))
    bounds = bands.select("band", "pivot", "d_min", "d_max").orderBy("band").toArrow()  # BANDS rows or so: three numbers each
    shared = spark.sparkContext.broadcast((bounds.column("band").to_numpy(), bounds.column("pivot").to_numpy(), bounds.column("d_min").to_numpy(), bounds.column("d_max").to_numpy()))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A need for each query's k-th score, that among the sample, and the band that promises most."""
        band, pivot, lo, hi = shared.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            own = b.column(0).to_numpy()
            scores = x @ s.T
            scores[s_rows[None, :] == own[:, None]] = -np.inf
            need = np.partition(scores, -k, axis=1)[:, -k] if len(s_rows) > k else np.full(b.num_rows, -np.inf)
            packed = [r.tobytes() for r in x.astype(kind)]
            _, norms, to_pivot = index.queries(packed)
            # of bands that hold the query's distance to their pivot, the one whose pivot is nearest
            home = band[np.concatenate([(-_reach(t, n, most, pivot, lo, hi) + 1e-9 * t[:, pivot]).argmin(1) for t, n in zip(np.array_split(to_pivot, len(x) // 256 + 1), np.array_split(norms, len(x) // 256 + 1), strict=True)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(need), pa.array(home)], ["row", "packed", "need", "band"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once more for every band but its first whose bound reaches its need."""
        band, pivot, lo, hi = shared.value
        for b in batches:
            _, norms, to_pivot = index.queries(b.column(1).to_pylist())
            need, home = b.column(2).to_numpy(), b.column(3).to_numpy()
            for at in range(0, b.num_rows, 64):
                part = slice(at, at + 64)
                open_ = (_reach(to_pivot[part], norms[part], most, pivot, lo, hi) >= need[part, None]) & (band[None, :] != home[part, None])
                r, c = np.nonzero(open_)
                if len(r):
                    at_rows = pa.array(r + at)
                    yield pa.RecordBatch.from_arrays([b.column(i).take(at_rows) for i in range(3)] + [pa.array(band[c]), b.column(4).take(at_rows)], ["row", "packed", "need", "band", "slab"])

    def expanded(queries: DataFrame) -> DataFrame:
        """Slabs of queries meet their bands; a band goes only to slabs that open it."""
        pairs = queries.select(F.col("band").alias("b_band"), F.col("slab").alias("b_slab")).distinct()
        sides = bands.join(pairs, F.col("band") == F.col("b_band")).select("b_band", "b_slab", "pivot", "ds", "ids", "rows", "vectors")
        met = queries.groupBy("band", "slab").cogroup(sides.groupBy("b_band", "b_slab"))
        return stored(met.applyInArrow(lambda q, b: index.expand(q, b), "row long, vec_id long, score double"))

    slabs = max(1, -(-(stats["asks"] or 0) // SLAB))
    schema = "row long, packed binary, need double, band long"
    first = rows.where("asks").select("row", "v").mapInArrow(begin, schema).repartitionByRange(slabs, "band", "row").withColumn("slab", F.spark_partition_id())
    first = stored(first)
    one = expanded(first)
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    kth = one.where("vec_id is not null").withColumn("rank", best).where(F.col("rank") == k).select("row", F.col("score").alias("kth"))
    needs = first.join(kth, "row", "left").select("row", "packed", F.greatest("need", "kth").alias("need"), "band", "slab")
    two = expanded(stored(needs.mapInArrow(more, schema + ", slab int")))
    both = one.union(two)
    ids = rows.where("asks").select("row", F.col("vec_id").alias("query_id"))
    if scored:
        return both.where("vec_id is null").groupBy("row").agg(F.sum("score").cast("long").alias("scored")).join(ids, "row").select("query_id", "scored")
    told = both.where("vec_id is not null").withColumn("rank", best).where(F.col("rank") <= k).join(ids, "row")
    return told.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), F.col("score").cast("long").alias("score"))
