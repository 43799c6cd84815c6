"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard, audited, then components.

Equal vectors of a label are one class. A label's classes are dealt into shards of bounded size. Each shard has one
graph, built once, in one task: classes are inserted in batches by searching the graph as it stands, a beam descending
the layers; on the lowest layer the search goes on through every member at the threshold or above, so that no beam
width cuts off a dense neighbourhood, and what it meets there are the class's links to those before it. So a shard's
own links come with its graph. Members that links join so far stand in a chain as well, for the nearest neighbours of a
dense group's members may be a part of it that nothing leaves or enters. Where a label has several shards, graphs are stored and each shard's classes query those
of the others, once for each two. Every graph and every such query audits its recall on sampled classes' true links,
found by brute force, and on queries turned away from their member, and widens the beam until both pass; a graph is
built anew at the first width at which its predecessor passes the second audit. Links are verified by cosine in double
precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspan.llm.common import components, stored
from talkspan.llm.simhash import forest

#: Classes of a shard; links of a member to those before it on a layer (twice as many with links back); ratio of a
#: layer to the one below.
SHARD, NEIGHBOURS, RATIO = 16384, 8, 16
BEAM = 24
AUDITED, RECALL = 128, 0.995
#: Queries that advance together, and those of the first batch of a graph.
TOGETHER, FIRST = 512, 64
#: Numbers in the blocks that a search or a choice works on: what a worker's memory holds at once, however wide the beam.
BLOCK = 1 << 21
#: By how much single precision may understate a cosine.
SLACK = 1e-5


@dataclass
class Graph:
    """Unit vectors (float32), and by layer from the lowest the members' links: numbers in the shard, -1 for none.
    The last two columns are a member's neighbours in its chain, on the lowest layer only."""

    x: np.ndarray
    links: list[np.ndarray]
    height: np.ndarray  # each member's highest layer
    size: int = 0  # members so far

    def __post_init__(self) -> None:
        self.mark = np.empty(0, np.int32)

    def top(self, most: int) -> np.ndarray:
        """Members of the highest layer in use: where searches begin."""
        here = np.nonzero(self.height[: self.size] == self.height[: self.size].max())[0]
        return here[:most]


def _advance(g: Graph, q: np.ndarray, level: int, beams: np.ndarray, beam: int, through: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Search of a layer for all queries at once, from each query's members `beams` (-1 for none). Returns queries and
    members of similarity `through` or more, and each query's `beam` best members with similarities, in no order."""
    n_q, n, links = len(q), len(g.x), g.links[level]
    if len(g.mark) < n_q * n:
        g.mark = np.empty(n_q * n, np.int32)
    seen = np.zeros(n_q * n, bool)

    def fresh(flat: np.ndarray) -> np.ndarray:
        flat = flat[~seen[flat]]
        place = np.arange(len(flat), dtype=np.int32)
        g.mark[flat] = place
        flat = flat[g.mark[flat] == place]  # one of those alike
        seen[flat] = True
        return flat

    r, c = np.nonzero(beams >= 0)
    flat = fresh(r * n + beams[r, c])
    best_s, best_i = np.full((n_q, beam), -2, np.float32), np.full((n_q, beam), -1, np.int64)
    hits = []
    while len(flat):
        rows = flat // n
        ids = flat - rows * n
        sims = np.empty(len(rows), np.float32)
        for a in range(0, len(rows), 32768):
            np.einsum("ij,ij->i", q[rows[a : a + 32768]], g.x[ids[a : a + 32768]], out=sims[a : a + 32768])
        hit = sims >= through
        if hit.any():
            hits.append((rows[hit].astype(np.int32), ids[hit].astype(np.int32)))
        may = sims > best_s.min(1)[rows]
        r, i, s = rows[may], ids[may], sims[may]
        who, first, count = np.unique(r, return_index=True, return_counts=True)  # rows rise
        step = max(1, BLOCK // (beam + int(count.max(initial=0))))
        for a in range(0, len(who), step):
            w, many = who[a : a + step], count[a : a + step]
            new = slice(first[a], first[a] + many.sum())
            at = np.repeat(np.arange(len(w)), many)
            place = beam + np.arange(first[a], new.stop) - np.repeat(first[a : a + step], many)
            wide_s = np.full((len(w), beam + int(many.max())), -2, np.float32)
            wide_i = np.full(wide_s.shape, -1, np.int32)
            wide_s[:, :beam], wide_i[:, :beam] = best_s[w], best_i[w]
            wide_s[at, place], wide_i[at, place] = s[new], i[new]
            pick = np.argpartition(-wide_s, beam - 1, axis=1)[:, :beam]
            best_s[w], best_i[w] = np.take_along_axis(wide_s, pick, 1), np.take_along_axis(wide_i, pick, 1)
        go = np.nonzero(hit | (sims >= best_s.min(1)[rows]))[0]
        step, then = BLOCK // (2 * links.shape[1]), []
        for a in range(0, len(go), step):
            near = links[ids[go[a : a + step]]]
            r, c = np.nonzero(near >= 0)
            then.append(fresh(rows[go[a : a + step]][r] * n + near[r, c]))
        flat = np.concatenate(then) if then else flat[:0]
    none = np.zeros(0, np.int64)
    r, i = [np.concatenate(x).astype(np.int64) for x in zip(*hits, strict=True)] if hits else (none, none)
    return r, i, best_i, best_s


def range_search(g: Graph, q: np.ndarray, beam: int, through: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries and members found at `through` or above. q: unit vectors, float32; TOGETHER of them at most."""
    beams = np.broadcast_to(g.top(beam), (len(q), len(g.top(beam))))
    for level in range(int(g.height[: g.size].max(initial=0)), 0, -1):
        _, _, beams, _ = _advance(g, q, level, beams, max(4, beam // 4), 2.0)
    r, i, _, _ = _advance(g, q, 0, beams, beam, through)
    return r, i


def _choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (-1 for none) m at most: from the nearest on, those nearer to the row's member than to
    one already chosen, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    n, wide = cand.shape
    if wide <= m:
        return cand
    step = max(1, BLOCK // (wide * max(wide, x.shape[1])))
    return np.concatenate([_chosen(x, cand[a : a + step], sims[a : a + step], m) for a in range(0, max(n, 1), step)])


def _chosen(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    n, wide = cand.shape
    v = x[np.maximum(cand, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, wide), bool)
    some = cand >= 0
    count = np.zeros(n, np.int64)
    for c in range(wide):
        closer = ((between[:, c, :c] > sims[:, c, None]) & chosen[:, :c]).any(1) if c else np.zeros(n, bool)
        chosen[:, c] = some[:, c] & ~closer & (count < m)
        count += chosen[:, c]
    rank = np.where(chosen, 0, np.where(some, wide, 2 * wide)) + np.arange(wide)
    pick = np.argpartition(rank, m - 1, axis=1)[:, :m]
    return np.take_along_axis(cand, pick, 1)


def _link_back(x: np.ndarray, links: np.ndarray, frm: np.ndarray, to: np.ndarray, sims: np.ndarray) -> None:
    """Members `to` get links to `frm`; those whose row is full choose anew among old and new ones."""
    width = links.shape[1]
    order = np.lexsort((-sims, to))
    frm, to, sims = frm[order], to[order], sims[order]
    who, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    few = place < width // 2  # of many newcomers the nearest
    at = np.repeat(np.arange(len(who)), count)[few]
    more = np.full((len(who), min(int(count.max()), width // 2)), -1, links.dtype)
    more_s = np.full(more.shape, -2, np.float32)
    more[at, place[few]], more_s[at, place[few]] = frm[few], sims[few]
    both = np.concatenate((links[who], more), axis=1)
    full = (both >= 0).sum(1) > width
    room = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
    links[who[~full]] = np.take_along_axis(both, room, 1)[~full]
    if full.any():
        w, b = who[full], both[full]
        s = np.concatenate((np.einsum("ij,ikj->ik", x[w], x[np.maximum(links[w], 0)]), more_s[full]), axis=1)
        links[w] = _choose(x, b, np.where(b >= 0, s, -2), width)


def _chain(links: np.ndarray, group: np.ndarray) -> None:
    """Members of a group, in their order, link to the one before and the one after in the last two columns."""
    order = np.argsort(group, kind="stable")
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    links[a[same], -1], links[b[same], -2] = b[same], a[same]


def build(vectors: np.ndarray, beam: int, through: float, met=None, groups=None, seed: int = 0, m: int = NEIGHBOURS) -> Graph:  # noqa: ANN001
    """The graph of `vectors`; met(later, earlier) is told of every two members found at `through` or above, once.
    groups() tells each member's group by what was met so far."""
    n = len(vectors)
    x = (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]).astype(np.float32)
    height = np.minimum(np.random.default_rng(seed).geometric(1 - 1 / RATIO, n) - 1, 8)
    g = Graph(x, [np.full((n, 2 * m + 2), -1, np.int32) for _ in range(int(height.max(initial=0)) + 1)], height)
    while g.size < n:
        lo = g.size
        hi = min(n, lo + min(TOGETHER, max(FIRST, lo // 2)))
        new = np.arange(lo, hi)
        q = x[lo:hi]
        within = q @ q.T
        within[np.arange(hi - lo), np.arange(hi - lo)] = -2
        if met is not None:
            a, b = np.nonzero(np.tril(within >= through))
            met(a + lo, b + lo)
        tops = int(height[:lo].max(initial=-1))
        beams = np.broadcast_to(g.top(beam), (hi - lo, len(g.top(beam)))) if lo else np.full((hi - lo, 1), -1)
        for level in range(int(height[:hi].max()), -1, -1):
            up = np.nonzero(height[lo:hi] >= level)[0]  # those that get links here
            cand_i, cand_s = np.full((len(up), beam), -1, np.int64), np.full((len(up), beam), -2, np.float32)
            if level == 0 and lo:
                r, i, cand_i, cand_s = _advance(g, q, 0, beams, beam, through)
                if met is not None:
                    met(r + lo, i)
            elif level <= tops:
                if len(up):
                    _, _, cand_i, cand_s = _advance(g, q[up], level, beams[up], beam, 2.0)
                _, _, beams, _ = _advance(g, q, level, beams, max(4, beam // 4), 2.0)
            if len(up) > 1:  # others of the batch
                s = within[np.ix_(up, up)]
                k = min(len(up) - 1, m)
                pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
                cand_i, cand_s = np.concatenate((cand_i, new[up][pick]), axis=1), np.concatenate((cand_s, np.take_along_axis(s, pick, 1)), axis=1)
            chosen = _choose(x, cand_i, cand_s, m)
            links = g.links[level][:, : 2 * m]
            links[new[up], : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            if len(r):
                frm, to = new[up][r], chosen[r, c]
                s = np.einsum("ij,ij->i", x[frm], x[to])
                _link_back(x, links, frm, to, s)
        if groups is not None:
            _chain(g.links[0][:hi], groups()[:hi])
        g.size = hi
    return g


def _truth(v: np.ndarray, norm: np.ndarray, which: np.ndarray, q: np.ndarray, q_norm: np.ndarray, threshold: float) -> np.ndarray:
    """How many of v reach the threshold with each of q[which]."""
    return np.concatenate([((q[w] @ v.T) / (q_norm[w][:, None] * norm) >= threshold).sum(1) for w in np.array_split(which, max(1, len(which) // 32))])


def turned_recall(g: Graph, which: np.ndarray, beam: int, through: float) -> float:
    """Share of members `which` that queries turned away from them, half-way to the threshold, reach.

    Few members may have links, and a member itself is found at once: such a query tests the way to a neighbour.
    """
    q = g.x[which].astype(float)
    near = (1 + min(through, 1.0)) / 2
    aside = np.random.default_rng(0).normal(size=q.shape)
    aside -= (aside * q).sum(1, keepdims=True) * q
    aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-12)
    turned = (near * q + np.sqrt(1 - near * near) * aside).astype(np.float32)
    if q.shape[1] < 2:  # nowhere to turn
        return 1.0
    r, i = range_search(g, turned, beam, through)
    return float((which[r] == i).sum()) / len(which)


class Links:
    """Verified links, as counts by weight and a forest, and the audit of those that sampled rows have."""

    def __init__(self, v: np.ndarray, weight: np.ndarray, threshold: float) -> None:
        self.v, self.norm, self.weight, self.threshold = v, np.sqrt((v * v).sum(1)), weight, threshold
        self.linked, self.label = np.zeros(len(v), np.int64), np.arange(len(v))
        self.found = np.zeros(len(v), np.int64)

    def met(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 1 << 16):
            r, i = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            good = np.einsum("ij,ij->i", self.v[r], self.v[i]) / (self.norm[r] * self.norm[i]) >= self.threshold
            r, i = r[good], i[good]
            for x, y in ((r, i), (i, r)):
                self.linked += np.bincount(x, self.weight[y], minlength=len(self.v)).astype(np.int64)
                self.found += np.bincount(x, minlength=len(self.v))
            if len(r):
                every = np.arange(len(self.v))
                self.label = forest(len(self.v), np.concatenate((r, every)), np.concatenate((i, self.label)))

    def recall(self, which: np.ndarray, truth: np.ndarray) -> float:
        """Mean over the sampled rows that have links of the share found: a dense group counts no more than a pair."""
        some = truth > 0
        return float((self.found[which][some] / truth[some]).mean()) if some.any() else 1.0

    def table(self, ids: np.ndarray) -> list[np.ndarray]:
        """Columns a, b, n: links of the forest (n = 0), and counts of links (b = a)."""
        moved, some = np.nonzero(self.label != np.arange(len(ids)))[0], np.nonzero(self.linked)[0]
        return [np.concatenate((ids[moved], ids[some])), np.concatenate((ids[self.label[moved]], ids[some])), np.concatenate((np.zeros(len(moved), np.int64), self.linked[some]))]


def _sample(n: int) -> np.ndarray:
    return np.arange(0, n, max(1, n // AUDITED))[:AUDITED]


def shard_graph(v: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[Graph, Links, int, float, float]:
    """The graph of a shard with its links, the beam that passed, and both audits' recall."""
    which, beam, through = _sample(len(v)), BEAM, threshold - SLACK
    truth = None
    while True:
        links = Links(v, weight, threshold)
        if truth is None:
            truth = _truth(v, links.norm, which, v, links.norm, threshold) - 1  # but itself
        g = build(v, beam, through, links.met, lambda: links.label)  # noqa: B023
        recall, turned = links.recall(which, truth), turned_recall(g, which, beam, through)
        if min(recall, turned) >= RECALL or beam >= len(v):
            return g, links, beam, recall, turned
        beam += beam // 2
        while beam < len(v) and turned_recall(g, which, beam, through) < RECALL:  # an audit costs little beside a graph
            beam += beam // 2


_BUILT = pa.schema([
    ("label", pa.int64()), ("dim", pa.int32()), ("s", pa.int64()), ("shards", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("beam", pa.int32()), ("recall", pa.float64()), ("turned", pa.float64()),
    ("ids", pa.binary()), ("weight", pa.binary()), ("v", pa.binary()), ("height", pa.binary()), ("links", pa.binary()),
])
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("beam", pa.int32()), ("recall", pa.float64()), ("turned", pa.float64())])


def _built(threshold: float):
    """A group is a shard. Rows of links (a, b, n), and a row with the audit and, where it has companions, the graph."""

    def go(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        # equal ids in no order would be equal classes; a shard is dealt by hash, so the order of ids is as good as random
        ids, weight = t.column("id").to_numpy(), t.column("n").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        g, links, beam, recall, turned = shard_graph(v, weight, threshold)
        a, b, n = links.table(ids)
        label, dim, s, shards = (k.as_py() for k in key)
        rows = pa.table({"a": a, "b": b, "n": n})
        many = shards > 1
        audit = {"beam": [beam], "recall": [recall], "turned": [turned], "weight": [weight.tobytes()], "v": [v.tobytes()], "height": [g.height.astype(np.int8).tobytes()], "links": [b"".join(x.tobytes() for x in g.links)], "ids": [ids.tobytes()]}
        last = pa.table({k: x if many or k in ("beam", "recall", "turned") else [None] for k, x in audit.items()}, schema=pa.schema([_BUILT.field(k) for k in audit]))
        out = pa.concat_tables([rows, last], promote_options="default")
        for name, value in (("label", label), ("dim", dim), ("s", s), ("shards", shards)):
            out = out.append_column(name, pa.array([value] * out.num_rows, _BUILT.field(name).type))
        return out.select(_BUILT.names).cast(_BUILT)

    return go


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph, int]:
    row = t.slice(0, 1).to_pylist()[0]
    ids, weight = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weight"], np.int64)
    v = np.frombuffer(row["v"]).reshape(len(ids), -1)
    height = np.frombuffer(row["height"], np.int8).astype(np.int64)
    links = np.frombuffer(row["links"], np.int32).reshape(int(height.max()) + 1, len(ids), -1)
    x = (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)
    return ids, weight, v, Graph(x, list(links), height, len(ids)), row["beam"]


def _queried(threshold: float):
    """Cogrouped: a shard's graph, and another's classes, which query it."""

    def go(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _MET.empty_table()
        m_ids, m_weight, mv, g, beam = _read(members)
        q_ids, q_weight, qv, asked, _ = _read(queries)
        first, through = len(m_ids), threshold - SLACK
        v, weight = np.concatenate((mv, qv)), np.concatenate((m_weight, q_weight))
        which = _sample(len(q_ids))
        norm = np.sqrt((v * v).sum(1))
        truth = _truth(mv, norm[:first], which, qv, norm[first:], threshold)
        while True:
            links = Links(v, weight, threshold)
            for at in range(0, len(q_ids), TOGETHER):
                r, i = range_search(g, asked.x[at : at + TOGETHER], beam, through)
                links.met(r + at + first, i)
            recall = links.recall(which + first, truth)
            if recall >= RECALL or beam >= first:
                break
            beam *= 2
        a, b, n = links.table(np.concatenate((m_ids, q_ids)))
        rows = pa.table({"a": a, "b": b, "n": n})
        last = pa.table({"beam": [beam], "recall": [recall]}, schema=pa.schema([_MET.field(k) for k in ("beam", "recall")]))
        out = pa.concat_tables([rows, last], promote_options="default")
        return out.append_column("turned", pa.nulls(out.num_rows, pa.float64())).select(_MET.names).cast(_MET)

    return go


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _keyed(rows: DataFrame) -> DataFrame:
    """vec_id, label, v, dim, h1, h2: v is null in rows that link with nothing. Vectors are scaled by their largest
    component, so that squares neither overflow nor vanish; equal ones have equal hashes."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    v = F.when(F.col("label").isNotNull() & finite & (top > 0), F.transform("embedding", lambda x: x.cast("double") / F.col("top")))
    keyed = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").withColumn("top", top).withColumn("v", v)
    return keyed.select("vec_id", "label", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def _graphs(rows: DataFrame, threshold: float, shard: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored: rows with keys, their classes, shards with their graphs, and what shards found in one another."""
    every = stored(_keyed(rows))
    # any row stands for its class
    classes = every.where("v is not null").groupBy("label", "dim", "h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes = stored(classes.withColumn("id", F.xxhash64("label", "dim", "h1", "h2")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")))
    built = stored(dealt.select("label", "dim", "s", "shards", "id", "n", "v").groupBy("label", "dim", "s", "shards").applyInArrow(_built(threshold), _ddl(_BUILT)))
    graphs = built.where("ids is not null").drop("a", "b", "n")
    members = graphs.where("s > 0").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    queries = graphs.where("s < shards - 1").withColumn("q", F.col("s")).withColumn("s", F.explode(F.sequence(F.col("s") + 1, F.col("shards") - 1)))
    keys = ["label", "dim", "s", "q"]
    return every, classes, built, stored(members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_queried(threshold), _ddl(_MET)))


def recall_audits(rows: DataFrame, threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """A row per graph and per query of one shard by another: beam, recall (of sampled classes' true links) and turned
    (of queries turned away from their member; null for queries of another shard)."""
    _, _, built, crossed = _graphs(rows, threshold, shard)
    return built.where("beam is not null").select("beam", "recall", "turned").union(crossed.where("beam is not null").select("beam", "recall", "turned"))


def near_duplicates(rows: DataFrame, threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links long, component_id long, kept boolean: a row for each row of `rows` (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and their cosine is `threshold` or more. n_links counts the
    other rows linked directly; component_id is the smallest vec_id reachable. Null vectors, zero vectors and those
    with null or non-finite components link with nothing; so do vectors of different length. A null vec_id has no
    component_id of its own and kept is null. Repeated rows are rows of their own and link with one another.
    """
    every, classes, built, crossed = _graphs(rows, threshold, shard)
    met = built.where("a is not null").select("a", "b", "n").union(crossed.where("a is not null").select("a", "b", "n"))
    counts = met.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    roots = components(met.where("n = 0").select("a", "b")).select(F.col("node").alias("id"), "root")
    rooted = classes.select("label", "dim", "h1", "h2", "id", "n", "least_id").join(roots, "id", "left").join(counts, "id", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "id")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(least, "root").select("label", "dim", "h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = every.where("v is not null").select("vec_id", "label", "dim", "h1", "h2").join(known, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = every.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
