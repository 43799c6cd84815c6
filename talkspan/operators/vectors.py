"""Centroids, similarities and clusterings of vectors.

What SQL can say stays in the JVM. Clusterings whose steps depend on one another run in one Python call per item
(`applyInPandas`): an item is one recording, so a group is bounded by its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkspan.functions import arrays
from talkspan.operators import signal


def centroids(rows: DataFrame, keys: list[str], vector: str = "vector", weight: str | None = None) -> DataFrame:
    """keys, centroid, n: the mean vector by keys, or the weighted mean; a dimension is a row on the way."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    dims = rows.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_d", "_x"))
    m = dims.groupBy(*keys, "_d").agg((F.sum(F.col("_w") * F.col("_x")) / F.greatest(F.lit(1e-8), F.sum("_w"))).alias("_x"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"])
    return m.groupBy(*keys).agg(ordered.alias("centroid"), F.first("n").alias("n"))


def nearest_centroid(rows: DataFrame, cents: DataFrame, keys: list[str], row_no: str, label: str) -> DataFrame:
    """keys, row_no, label, cosine: each row's most similar centroid of its item, the lower label at a tie. cents:
    keys, label, centroid (unit vectors). Rows meet the centroids of their item only."""
    pairs = rows.join(cents.select(*keys, F.col(label).alias("_c"), "centroid"), keys)
    pairs = pairs.withColumn("cosine", arrays.dot(F.col("vector"), F.col("centroid")))
    best = F.max(F.struct(F.col("cosine"), (-F.col("_c")).alias("m")))
    return pairs.groupBy(*keys, row_no).agg(best.alias("b")).select(*keys, row_no, (-F.col("b.m")).cast("int").alias(label), F.col("b.cosine").alias("cosine"))


def reassign_minor(rows: DataFrame, keys: list[str], row_no: str, label: str, least: int = 4) -> DataFrame:
    """keys, row_no, label: rows of labels with fewer than `least` rows go to the nearest other label; items without
    a larger label get 0 throughout."""
    n = F.count("*").over(Window.partitionBy(*keys, label))
    r = rows.withColumn("_n", n)
    c = centroids(r.where(F.col("_n") >= least), [*keys, label]).withColumn("centroid", arrays.l2(F.col("centroid")))
    moved = nearest_centroid(r.where(F.col("_n") < least).select(*keys, row_no, "vector"), c, keys, row_no, label).select(*keys, row_no, F.col(label).alias("_to"))
    out = r.select(*keys, row_no, label, "_n").join(moved, [*keys, row_no], "left")
    return out.select(*keys, row_no, F.when(F.col("_n") >= least, F.col(label)).otherwise(F.coalesce("_to", F.lit(0))).alias(label))


def affinity(rows: DataFrame, keys: list[str], no: str) -> DataFrame:
    """keys, i, j, cosine: of all pairs i < j of an item's vectors."""
    a = rows.select(*keys, F.col(no).alias("i"), F.col("vector").alias("a"))
    b = rows.select(*keys, F.col(no).alias("j"), F.col("vector").alias("b"))
    return a.join(b, keys).where("i < j").select(*keys, "i", "j", arrays.dot(F.col("a"), F.col("b")).alias("cosine"))


def prune(pairs: DataFrame, keys: list[str], drop: int) -> DataFrame:
    """Full affinity rows (keys, i, j, cosine) with the `drop` lowest of each row set to 0."""
    w = Window.partitionBy(*keys, "i").orderBy("cosine", "j")
    return pairs.withColumn("cosine", F.when(F.row_number().over(w) <= drop, 0.0).otherwise(F.col("cosine")))


def first_seen_labels(labels: np.ndarray) -> np.ndarray:
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Labels by first occurrence; greedy k-means++ from a fixed seed. An empty cluster takes the farthest point."""
    rng = np.random.RandomState(seed)
    n = len(x)
    sq = (x * x).sum(1)
    dist = lambda c: np.maximum(sq + (c * c).sum() - 2 * x @ c, 0)
    centres = [x[rng.randint(n)]]
    closest = dist(centres[0])
    for _ in range(1, k):
        draws = rng.random_sample(2 + int(np.log(k))) * closest.sum()
        tried = np.minimum(np.searchsorted(np.cumsum(closest), draws), n - 1)
        after = [np.minimum(closest, dist(x[t])) for t in tried]
        best = int(np.argmin([a.sum() for a in after]))
        closest = after[best]
        centres.append(x[tried[best]])
    c = np.array(centres)
    limit = tolerance * x.var(axis=0).mean()
    for _ in range(rounds):
        d = np.maximum(sq[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)
        label = d.argmin(1)
        new = c.copy()
        for j in range(k):
            new[j] = x[label == j].mean(0) if (label == j).any() else x[d[np.arange(n), label].argmax()]
        moved = ((new - c) ** 2).sum()
        c = new
        if moved <= limit:
            break
    d = np.maximum(sq[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)
    return first_seen_labels(d.argmin(1))


def spectral(x: np.ndarray, most: int = 15, keep: float = 0.012, least: int = 6) -> np.ndarray:
    """Labels of unit vectors: affinity with the lowest of each row removed, symmetrised; Laplacian; the number of
    clusters by the largest eigengap; k-means on the eigenvectors. Fewer than ten vectors are one cluster."""
    n = len(x)
    if n < 10:
        return np.zeros(n, int)
    a = x @ x.T
    drop = max(0, min(int((1 - keep) * n), n - least))
    low = np.argsort(a, axis=1, kind="stable")[:, :drop]
    np.put_along_axis(a, low, 0, axis=1)
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    values, vectors = np.linalg.eigh(np.diag(np.abs(a).sum(1)) - a)
    k = 1 + int(np.argmax(np.diff(values[: min(most, n - 1) + 1])))
    return kmeans(vectors[:, :k], k) if k > 1 else np.zeros(n, int)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def merge_close(x: np.ndarray, labels: np.ndarray, above: float = 0.875) -> np.ndarray:
    """Joins the two most similar centroids while their cosine is above the limit."""
    labels = labels.copy()
    while len(ids := np.unique(labels)) > 1:
        c = unit(np.array([x[labels == i].mean(0) for i in ids]))
        s = np.triu(c @ c.T, 1) - 2 * np.tril(np.ones((len(ids), len(ids))))
        i, j = np.unravel_index(np.argmax(s), s.shape)
        if s[i, j] <= above:
            break
        labels[labels == ids[j]] = ids[i]
    return labels


def agglomerate(x: np.ndarray, within: float = 0.6) -> np.ndarray:
    """Centroid linkage by Euclidean distance; merges within the limit count. Labels by first occurrence."""
    n = len(x)
    centre, size, label = x.astype(float).copy(), np.ones(n), np.arange(n)
    live = np.ones(n, bool)
    d = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(-1), 0))
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        height = d[i, j]
        if height <= within:
            label[label == label[j]] = label[i]
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        live[j] = False
        d[j, :] = d[:, j] = np.inf
        new = np.sqrt(((centre - centre[i]) ** 2).sum(1))
        new[~live] = np.inf
        new[i] = np.inf
        d[i, :] = d[:, i] = new
    return first_seen_labels(label)


def vbx(x: np.ndarray, phi: np.ndarray, labels: np.ndarray, fa: float = 0.07, fb: float = 0.8, rounds: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Variational clustering of projected vectors x with between-class variances phi, from hard labels: posteriors
    and priors of the clusters."""
    n, dim = x.shape
    gamma = np.exp(7.0 * np.eye(labels.max() + 1)[labels])
    gamma /= gamma.sum(1, keepdims=True)
    pi = np.full(gamma.shape[1], 1 / gamma.shape[1])
    const = -0.5 * ((x * x).sum(1) + dim * np.log(2 * np.pi))
    rho = x * np.sqrt(phi)
    before = -np.inf
    for _ in range(rounds):
        inv = 1 / (1 + fa / fb * gamma.sum(0)[:, None] * phi)
        alpha = fa / fb * inv * (gamma.T @ rho)
        log_p = fa * (rho @ alpha.T - 0.5 * (inv + alpha**2) @ phi + const[:, None])
        joint = log_p + np.log(pi + 1e-8)
        top = joint.max(1, keepdims=True)
        log_x = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        gamma = np.exp(joint - log_x[:, None])
        pi = gamma.sum(0) / gamma.sum()
        bound = log_x.sum() + fb * 0.5 * (np.log(inv) - inv - alpha**2 + 1).sum()
        if bound - before < tolerance:
            break
        before = bound
    return gamma, pi


def assign(scores: np.ndarray) -> np.ndarray:
    """Distinct clusters for up to three local speakers (rows) with the greatest sum; -1 where there are too few
    clusters. The first combination at a tie."""
    from itertools import permutations

    s, k = scores.shape
    if s == 3 and k >= 3:
        total = scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None, :]
        a, b, c = np.indices(total.shape, sparse=True)
        total = np.where((a == b) | (a == c) | (b == c), -np.inf, total)
        return np.array(np.unravel_index(np.argmax(total), total.shape))
    best, pick = -np.inf, np.full(s, -1)
    rows = range(min(s, k))
    for speakers in permutations(range(s), len(rows)) if k < s else [tuple(range(s))]:
        for clusters in permutations(range(k), len(rows)):
            value = sum(scores[a, b] for a, b in zip(speakers, clusters, strict=True))
            if value > best:
                best, pick = value, np.full(s, -1)
                pick[list(speakers)] = clusters
    return pick


@dataclass(frozen=True)
class Projection:
    """Fixed parameters of the space that variational clustering works in: an x-vector transform, then a basis of unit
    within-class variance and its between-class variances."""

    mean1: np.ndarray
    lda: np.ndarray
    mean2: np.ndarray
    mu: np.ndarray
    basis: np.ndarray
    phi: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (signal.xvector(x, self.mean1, self.lda, self.mean2) - self.mu) @ self.basis.T


def chunk_labels(x: np.ndarray, alone: np.ndarray, active: np.ndarray, project: Projection, within: float = 0.6, least: float = 0.2) -> np.ndarray:
    """Clusters of local speakers: x is chunks x speakers x dim, `alone` the share of frames in which a speaker is the
    only one, `active` whether it speaks at all. -2 for those that do not and those left without a cluster.

    Vectors that are finite and alone for `least` of the frames train: agglomerative labels begin, posteriors in the
    projected space decide, clusters with a prior above 1e-7 have centroids by posterior, and each chunk's speakers go
    to distinct ones. With fewer than two such vectors every speaker keeps its number in the chunk.
    """
    chunks, speakers, dim = x.shape
    finite = np.isfinite(x).all(2)
    train = x[finite & (alone >= least)]
    if len(train) < 2:
        return np.where(active, np.arange(speakers)[None, :], -2)
    gamma, pi = vbx(project(train), project.phi, agglomerate(train / np.sqrt(np.maximum((train * train).sum(1, keepdims=True), 1e-20)), within))
    gamma = gamma[:, pi > 1e-7] if (pi > 1e-7).any() else gamma[:, :1]
    c = (gamma.T @ train) / np.maximum(gamma.sum(0), 1e-8)[:, None]
    flat = np.where(finite[:, :, None], x, 0).reshape(-1, dim)
    length = lambda v: np.sqrt((v * v).sum(1))
    scores = (1 + flat @ c.T / (length(flat)[:, None] * length(c)[None, :] + 1e-10)).reshape(chunks, speakers, -1)
    out = np.full((chunks, speakers), -2)
    for n in range(chunks):
        idle = ~(active[n] & finite[n])
        scores[n, idle] = scores[n].min() - 1
        found = assign(scores[n])
        out[n] = np.where(active[n] & (found >= 0), found, -2)
    return out


def chunk_speakers(rows: DataFrame, key: str, project: Projection, speakers: int = 3) -> DataFrame:
    """key, chunk, speaker, label: rows (key, chunk, speaker 0.., vector, alone double, active boolean) of an item
    clustered by chunk_labels(); a speaker without a row is one that does not speak."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "speaker"])
        _, at = np.unique(pdf["chunk"], return_inverse=True)
        n, who = int(at.max()) + 1, pdf["speaker"].to_numpy()
        x = np.full((n, speakers, project.lda.shape[0]), np.nan)
        alone, active = np.zeros((n, speakers)), np.zeros((n, speakers), bool)
        some = pdf["vector"].map(lambda v: v is not None and len(v) == x.shape[2]).to_numpy(bool)
        if some.any():
            x[at[some], who[some]] = np.stack(pdf["vector"][some].to_numpy())
        alone[at, who], active[at, who] = pdf["alone"].to_numpy(), pdf["active"].to_numpy(bool)
        return pd.DataFrame({key: pdf[key], "chunk": pdf["chunk"], "speaker": who, "label": chunk_labels(x, alone, active, project)[at, who].astype("int32")})

    kinds = dict(rows.dtypes)
    return rows.select(key, "chunk", "speaker", "vector", "alone", "active").groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, chunk {kinds['chunk']}, speaker {kinds['speaker']}, label int")


def clustered(rows: DataFrame, key: str, no: str, method: str) -> DataFrame:
    """key, no, label: vectors of each item clustered by "spectral", "recording" (spectral, then small clusters to
    their neighbours, close ones joined, and labels by size), "agglomerative", "kmeans" (k = 4) or "vbx"."""
    methods = {"spectral": spectral, "agglomerative": lambda x: agglomerate(x, 0.6), "kmeans": lambda x: kmeans(x, min(4, len(x))), "recording": recording, "vbx": _vbx_labels}
    run = methods[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(no)
        return pd.DataFrame({key: pdf[key], no: pdf[no], "label": run(unit(np.stack(pdf["vector"].to_numpy()))).astype("int32")})

    kinds = dict(rows.dtypes)
    return rows.select(key, no, "vector").groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, {no} {kinds[no]}, label int")


def recording(x: np.ndarray, least: int = 4) -> np.ndarray:
    labels = spectral(x)
    ids, n = np.unique(labels, return_counts=True)
    major = ids[n >= least]
    if not len(major):
        return np.zeros(len(x), int)
    c = unit(np.array([x[labels == i].mean(0) for i in major]))
    small = ~np.isin(labels, major)
    labels[small] = major[(x[small] @ c.T).argmax(1)]
    labels = merge_close(x, labels)
    ids, n = np.unique(labels, return_counts=True)
    return np.argsort(np.argsort(-n, kind="stable"))[np.searchsorted(ids, labels)]


def _vbx_labels(x: np.ndarray) -> np.ndarray:
    """Clusters that the posteriors keep (prior above 1e-7), on vectors scaled as if whitened."""
    phi = np.linspace(2.0, 0.2, x.shape[1])
    gamma, pi = vbx(x * np.sqrt(x.shape[1]), phi, agglomerate(x, 0.6))
    return first_seen_labels(gamma[:, pi > 1e-7].argmax(1))
