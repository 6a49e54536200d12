"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes go to the shards of their OVERLAP nearest centers, so that near vectors nearly always share
one; a large shard is cut into parts at random. In each part a graph is built by inserting nodes in batches of growing
size: each searches greedily from the part's medoids, robust pruning picks its neighbours among those it met, and these get
edges back. The lists of a node from all its shards are united. Then each node of a shard searches each part of it: greedily
from the medoids, and from all within range that this finds on over their neighbours, until
no more are in range. What is found is verified in doubles. A pair of nodes is counted in the first shard that both
are in, so that counts add up; links are not listed, each task gives a node's count and a spanning forest of its links.

Shards overlap and parts are searched by all of a shard's nodes, so no task holds more than two parts. The recall is measured on a
bounded sample of vectors against all others by brute force, and where it falls short the work is done again with twice the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import freed
from .common import saved, temporary
from .components import components

#: Vectors that centers are fitted on, at least and at most; nodes a center is meant for, and centers at most (they are broadcast).
SAMPLE, MOST_SAMPLED, TARGET, MOST_CENTERS = 16_384, 65_536, 1_500, 16_384
#: Shards a node is in, nodes of a part.
OVERLAP, PART = 3, 6_000
#: Neighbours of a node in a part's graph, beam of a search, and how much nearer a neighbour has to be to a candidate to rule it out.
DEGREE, BEAM, ALPHA = 24, 48, 1.2
#: Medoids that searches in a part start from, and lists that hold a node at least.
ENTRIES, HELD_BY = 16, 4
#: Searches that go on together, and components of vectors that are held at once to judge pairs.
TOGETHER, HELD = 512, 1 << 24
#: Vectors of the audit, the recall that it asks for, and how much of the threshold navigation in floats may be off.
AUDITED, RECALL, SLACK = 200, 0.97, 1e-4


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in doubles, null where it links with nothing."""
    if vector is None or not len(vector) or None in vector:
        return None
    x = np.asarray(vector, np.float64)
    with np.errstate(over="ignore"):
        return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Binary vectors as unit rows of one width, the shorter filled with zeros (the longer cut, if a width is given), and their sizes."""
    rows = [np.frombuffer(x, np.float64) for x in column.to_pylist()]
    size = np.array([len(x) for x in rows], np.int64)
    out = np.zeros((len(rows), width or int(size.max(initial=1))))
    for r, x in zip(out, rows, strict=True):
        r[: len(x)] = x[: len(r)]
    out[~out.any(axis=1), 0] = 1
    return unit(out), size


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in freed(batches):
        vectors = [usable(v) for v in batch.column(1).to_pylist()]
        raw = [None if v is None else (v + 0.0).tobytes() for v in vectors]  # -0.0 is 0.0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r and xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vec"])


def fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """k centers of unit vectors by a few rounds of spherical k-means, from a start that is the same each time."""
    rng = np.random.default_rng(11)
    x = sample.astype(np.float32)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        own = np.concatenate([(x[a : a + 4096] @ centers.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        long = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(long > 1e-6, sums / np.maximum(long, 1e-6), centers).astype(np.float32)
    return centers


class Graph:
    """Unit vectors of a part (floats) with their neighbours: a row of ``edges`` each, filled up with -1."""

    def __init__(self, x: np.ndarray, beam: int = BEAM) -> None:
        self.x, self.beam = x, beam
        self.edges = np.full((len(x), DEGREE), -1, np.int32)
        self.medoids = self.entries()

    def entries(self) -> np.ndarray:
        """Where searches start: the medoid of all, and of the groups around nodes that are far from it and from each other, so
        that a crowd of near copies, whose lists are full of each other, can't shut a search in."""
        first = int((self.x @ self.x.mean(axis=0)).argmax())
        seeds, near = [first], self.x @ self.x[first]
        while len(seeds) < ENTRIES and near.min() < 0.9:
            seeds.append(int(near.argmin()))
            near = np.maximum(near, self.x @ self.x[seeds[-1]])
        group = (self.x @ self.x[seeds].T).argmax(axis=1)
        out = [first]
        for g in range(1, len(seeds)):
            own = np.flatnonzero(group == g)
            out.append(int(own[(self.x[own] @ self.x[own].mean(axis=0)).argmax()]))
        return np.unique(out)

    def search(self, queries: np.ndarray, threshold: float | None) -> tuple[np.ndarray, ...]:
        """Greedy search of all queries at once, from the medoids.

        Without a threshold: the nodes of each query's beam, with their similarities (-1, -inf where there are fewer).
        With one: the pairs (query, node) in range, from the beam and on over their neighbours.
        """
        m, q, width = len(self.x), len(queries), self.beam
        seen = np.zeros((q, m), bool)
        beam, close, done = np.full((q, width), -1, np.int32), np.full((q, width), -np.inf, np.float32), np.ones((q, width), bool)
        n = len(self.medoids)
        beam[:, :n], done[:, :n], close[:, :n] = self.medoids, False, queries @ self.x[self.medoids].T
        seen[:, self.medoids] = True
        live = np.arange(q)
        while len(live):
            best = np.where(done[live], -np.inf, close[live]).argmax(axis=1)
            going = ~done[live, best]
            live, best = live[going], best[going]
            if not len(live):
                break
            done[live, best] = True
            to = self.edges[beam[live, best]]
            fresh = to >= 0
            fresh &= ~seen[live[:, None], np.maximum(to, 0)]
            row, col = np.nonzero(fresh)
            seen[live[row], to[row, col]] = True
            sims = np.full(to.shape, -np.inf, np.float32)
            sims[row, col] = np.einsum("ij,ij->i", queries[live[row]], self.x[to[row, col]])
            all_nodes, all_close = np.concatenate((beam[live], np.where(fresh, to, -1)), axis=1), np.concatenate((close[live], sims), axis=1)
            all_done = np.concatenate((done[live], ~fresh), axis=1)
            keep = np.argpartition(-all_close, width - 1, axis=1)[:, :width]
            beam[live], close[live], done[live] = (np.take_along_axis(a, keep, axis=1) for a in (all_nodes, all_close, all_done))
        if threshold is None:
            return beam, close
        row, col = np.nonzero(close >= threshold)
        found, front = [(row, beam[row, col])], (row, beam[row, col])
        reached = np.zeros((q, m), bool)
        reached[front] = True
        while len(front[0]):  # a node may have been seen and left out of the beam: its similarity is taken anew
            ahead: list[tuple[np.ndarray, np.ndarray]] = []
            step = max(1, HELD // (self.edges.shape[1] * self.x.shape[1]))
            for a in range(0, len(front[0]), step):
                r, n = (f[a : a + step] for f in front)
                to = self.edges[n]
                r, to = np.repeat(r, to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
                new = ~reached[r, to]
                code = np.unique(r[new].astype(np.int64) * m + to[new])
                r, to = code // m, code % m
                reached[r, to] = True
                near = np.einsum("ij,ij->i", queries[r], self.x[to]) >= threshold
                ahead.append((r[near], to[near]))
            front = tuple(np.concatenate([x[i] for x in ahead]) for i in (0, 1))
            found.append(front)
        return tuple(np.concatenate([x[i] for x in found]) for i in (0, 1))

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray, close: np.ndarray) -> None:
        """Robust pruning: each node takes its nearest candidate, and those go that are ALPHA times nearer to it than to the
        node; and again. What is left over fills the list, nearest first."""
        n, c = candidates.shape
        close = np.where((candidates < 0) | (candidates == nodes[:, None]), -np.inf, close)
        order = np.argsort(-close, axis=1, kind="stable")
        candidates, close = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(close, order, axis=1)
        same = np.zeros((n, c), bool)
        by_node = np.argsort(candidates, axis=1, kind="stable")
        ranked = np.take_along_axis(candidates, by_node, axis=1)
        np.put_along_axis(same, by_node[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
        usable_ = np.isfinite(close) & ~same
        open_, taken = usable_.copy(), np.zeros((n, c), bool)
        at = np.arange(n)
        vectors = self.x[np.maximum(candidates, 0)]
        for _ in range(DEGREE):
            first = open_.argmax(axis=1)
            some = open_[at, first]
            if not some.any():
                break
            taken[at[some], first[some]] = True
            open_[at[some], first[some]] = False
            between = np.einsum("ijk,ik->ij", vectors, vectors[at, first])
            open_ &= ~(some[:, None] & (ALPHA * ALPHA * (1 - between) <= 1 - close))
        # taken ones first, then the nearest of the others
        rank = np.where(taken, 0, np.where(usable_, 1, 2)) * c + np.arange(c)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :DEGREE]
        chosen = np.where(np.take_along_axis(usable_, pick, axis=1), np.take_along_axis(candidates, pick, axis=1), -1)
        self.edges[nodes, : chosen.shape[1]] = chosen
        self.edges[nodes, chosen.shape[1] :] = -1

    def build(self) -> None:
        order = np.random.default_rng(7).permutation(len(self.x)).astype(np.int32)
        at = len(self.medoids)
        order = np.concatenate((self.medoids, order[~np.isin(order, self.medoids)])).astype(np.int32)
        start = self.medoids
        sims = self.x[start] @ self.x[start].T
        self.pruned(start, np.broadcast_to(start, (at, at)), sims)
        while at < len(order):
            batch = order[at : min(2 * at, at + 8 * TOGETHER)]
            for a in range(0, len(batch), TOGETHER):
                those = batch[a : a + TOGETHER]
                beam, close = self.search(self.x[those], None)
                sims = self.x[those] @ self.x[those].T  # nodes that come together may be each other's nearest
                k = min(8, len(those))
                mates = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                beam, close = np.concatenate((beam, those[mates]), axis=1), np.concatenate((close, np.take_along_axis(sims, mates, axis=1)), axis=1)
                self.pruned(those, beam, close)
                self.edges_back(those)
            at += len(batch)

    def edges_back(self, nodes: np.ndarray) -> None:
        """An edge back from each neighbour; lists that grow too long are pruned. New edges of a node are at most as many as
        the nodes that come together, and are pruned by DEGREE at a time."""
        to = self.edges[nodes]
        u, v = to[to >= 0], np.repeat(nodes, DEGREE)[to.ravel() >= 0]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        place = np.arange(len(u)) - np.searchsorted(u, u)
        for lap in range(int(place.max(initial=-1)) // DEGREE + 1):
            now = place // DEGREE == lap
            who, first = np.unique(u[now], return_inverse=True)
            new = np.full((len(who), DEGREE), -1, np.int32)
            new[first, place[now] % DEGREE] = v[now]
            for a in range(0, len(who), TOGETHER):
                some = slice(a, a + TOGETHER)
                candidates = np.concatenate((self.edges[who[some]], new[some]), axis=1)
                close = np.einsum("ijk,ik->ij", self.x[np.maximum(candidates, 0)], self.x[who[some]])
                self.pruned(who[some], candidates, close)


    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """All edges as (from, to), in order. Pruning may leave a node that few lists hold; its nearest neighbours hold it then."""
        who, to = np.repeat(np.arange(len(self.x)), self.edges.shape[1]), self.edges.ravel()
        who, to = who[to >= 0], to[to >= 0].astype(np.int64)
        rare = np.flatnonzero(np.bincount(to, minlength=len(self.x)) < HELD_BY)
        back = self.edges[rare, :HELD_BY]
        who, to = np.concatenate((who, back[back >= 0])), np.concatenate((to, np.repeat(rare, HELD_BY)[back.ravel() >= 0]))
        return tuple(np.unique(np.stack((who, to)), axis=1))

    def take(self, who: np.ndarray, to: np.ndarray) -> None:
        """Takes these edges, in order of ``who``, for its own."""
        place = np.arange(len(who)) - np.searchsorted(who, who)
        self.edges = np.full((len(self.x), int(place.max(initial=0)) + 1), -1, np.int32)
        self.edges[who, place] = to


def _built(part: pa.Table) -> pa.Table:
    part = part.combine_chunks()
    nodes = part.column("node").to_numpy()
    x, _ = matrix(part.column("vec"))
    graph = Graph(x.astype(np.float32))
    graph.build()
    who, to = graph.lists()
    ends = np.searchsorted(who, np.arange(len(nodes) + 1))
    return pa.table({"node": pa.array(nodes), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nodes[to]))})


def _hooked(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the trees of ``lab`` (each node's least node so far) that pairs (a, b) connect."""
    while True:
        x, y = lab[a], lab[b]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab[:] = up
        a, b = a[apart], b[apart]


def searched(threshold: float, beam: int):
    """The links that the nodes of one part of a shard (``query``) have in another or the same (``graph``): a row for each
    node that has any, with the number of vectors it links with and the least node of its tree."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks().sort_by("node")
        nodes, shard = cell.column("node").to_numpy(), cell.column("shard")[0].as_py()
        both = cell.column("part").to_numpy()
        in_graph, asks = both == cell.column("graph")[0].as_py(), both == cell.column("query")[0].as_py()
        exact, size = matrix(cell.column("vec"))
        copies, homes = cell.column("copies").to_numpy(), np.array(cell.column("shards").to_pylist(), np.int64)
        members, askers = np.flatnonzero(in_graph), np.flatnonzero(asks)
        lab, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        if len(members) and len(askers):
            graph = Graph(exact[members].astype(np.float32), beam)
            near = [x or [] for x in cell.column("near").take(pa.array(members)).to_pylist()]
            flat, who = np.array([v for x in near for v in x], np.int64), np.repeat(np.arange(len(members)), [len(x) for x in near])
            at = np.minimum(np.searchsorted(nodes[members], flat), len(members) - 1)
            here = nodes[members][at] == flat
            who, at = who[here], at[here]
            graph.take(who, at)
            for a in range(0, len(askers), TOGETHER):
                those = askers[a : a + TOGETHER]
                q, x = graph.search(exact[those].astype(np.float32), threshold - SLACK)
                step = max(1, HELD // exact.shape[1])
                for b in range(0, len(q), step):
                    i, j = those[q[b : b + step]], members[x[b : b + step]]
                    first = np.where((homes[i][:, :, None] == homes[j][:, None, :]).any(axis=2), homes[i], np.iinfo(np.int64).max).min(axis=1)
                    ours = (i != j) & (first == shard) & (size[i] == size[j])
                    i, j = i[ours], j[ours]
                    near_ = np.einsum("ij,ij->i", exact[i], exact[j]) >= threshold
                    i, j = i[near_], j[near_]
                    links += np.bincount(i, copies[j], len(nodes)).astype(np.int64)
                    _hooked(lab, i, j)
        out = np.flatnonzero((links > 0) | (lab != np.arange(len(nodes))))
        return pa.table({"node": pa.array(nodes[out]), "links": pa.array(links[out]), "least": pa.array(nodes[lab[out]])})

    return run


def _audited(sample: pa.Table, threshold: float):
    """Of each batch of (node, copies, vec), the vectors that each audited one links with."""
    names, (own, sizes) = sample.column("node").to_numpy(), matrix(sample.column("vec").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            x, size = matrix(batch.column(2), own.shape[1])
            near = (x @ own.T >= threshold) & (size[:, None] == sizes) & (batch.column(0).to_numpy()[:, None] != names)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(near.T @ batch.column(1).to_numpy())], names=["node", "links"])

    return run


def _homes(centers, width: int, overlap: int):
    """(node, copies, vec) with the shards of each: its nearest centers, in order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        n = min(overlap, len(c))
        for batch in freed(batches):
            x, _ = matrix(batch.column(2), width)
            near = np.concatenate([np.argpartition(-(x[a : a + TOGETHER].astype(np.float32) @ c.T), n - 1, axis=1)[:, :n] for a in range(0, len(x), TOGETHER)] or [np.empty((0, n), np.int64)])
            shards = pa.FixedSizeListArray.from_arrays(pa.array(np.sort(near, axis=1).ravel(), pa.int32()), n).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, shards], names=["node", "copies", "vec", "shards"])

    return run


def linked(nodes: DataFrame, threshold: float, overlap: int, beam: int) -> DataFrame:
    """(node, links, least): of each node and cell that has found any, the vectors it links with and a node of its component."""
    spark, n = nodes.sparkSession, nodes.count()
    k = min(MOST_CENTERS, -(-n // TARGET))
    step = max(1, n // min(MOST_SAMPLED, max(SAMPLE, 16 * k)))
    sample, _ = matrix(nodes.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("vec").toArrow().column("vec").combine_chunks())
    if not len(sample):
        sample, _ = matrix(nodes.orderBy("node").limit(1).select("vec").toArrow().column("vec").combine_chunks())
    centers = spark.sparkContext.broadcast(fitted(sample, k))
    homes = saved(nodes.select("node", "copies", "vec").mapInArrow(_homes(centers, sample.shape[1], overlap), "node long, copies long, vec binary, shards array<int>"), "homes")
    inside = homes.withColumn("shard", F.explode("shards"))
    parts = inside.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row for each center
    inside = inside.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    built = inside.select("shard", "part", "node", "vec").groupBy("shard", "part").applyInArrow(_built, "node long, near array<long>")
    flat = saved(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    cell = lambda g, q: F.struct(g.alias("graph"), q.alias("query"))
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.concat(F.transform(all_parts, lambda j: cell(F.col("part"), j)), F.transform(F.filter(all_parts, lambda i: i != F.col("part")), lambda i: cell(i, F.col("part"))))
    rows = inside.join(flat, "node").select("shard", "part", "node", "copies", "vec", "shards", "near", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    return saved(rows.groupBy("shard", "graph", "query").applyInArrow(searched(threshold, beam), "node long, links long, least long"), "found")


def recall(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """The share of the links of AUDITED nodes, the first by hash, that were found; brute force over all nodes."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", "vec").toArrow()
    true = nodes.select("node", "copies", "vec").mapInArrow(_audited(sample, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    have = found.groupBy("node").agg(F.sum("links").alias("links"))
    row = true.join(have, "node", "left").agg(F.sum("true").alias("true"), F.sum(F.coalesce("links", F.lit(0))).alias("links")).first()
    return row.links / row.true if row.true else 1.0


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Returns ``id_col``, n_links, component_id, kept for every row of ``vectors``.

    Two rows link if the cosine of their vectors is the threshold or more; rows of equal vectors always do. Vectors that are null,
    empty, zero or have null or non-finite components link with nothing, nor do vectors of different sizes with each other.
    n_links counts the other rows that a row links with, component_id is the smallest id that links lead to (its own included),
    and a row is kept if it has that id. Rows with a null id take part and get the smallest id that isn't null; where there is
    none they get null and are kept. Repeated rows each give a row. An empty table gives no rows; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    keyed = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(_keys, f"id {kind}, key binary, vec binary")

    def found() -> DataFrame:
        # numbered as they lie in the files written first, so that a number never changes
        classes = saved(keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.first("vec").alias("vec")), "classes")
        nodes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        alone = keyed.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        if nodes.isEmpty():
            return alone
        overlap, beam = OVERLAP, BEAM
        while True:
            links = linked(nodes, threshold, overlap, beam)
            if overlap * TARGET >= nodes.count() or recall(nodes, links, threshold) >= RECALL:
                break
            overlap, beam = 2 * overlap, 2 * beam
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(links.select(F.col("node").alias("u"), F.col("least").alias("v")))
        of = nodes.select("node", "key", "copies", "least_id").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of = saved(of, "roots")
        ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
        told = of.join(ids, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        return keyed.where("key is not null").select("id", "key").join(told, "key").select("id", "n_links", "component_id").unionByName(alone)

    with temporary(vectors.sparkSession):
        return saved(found().select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "near-vectors", keep=True)
