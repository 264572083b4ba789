"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard queried, cosine verified."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import connected_components

THRESHOLD = 0.93
#: Vectors of one shard, about; links of a node above and in the lowest layer; beams of building and first search.
SHARD, LINKS, LINKS0, BUILD_BEAM, BEAM = 4096, 16, 32, 64, 96
#: Nodes expanded at once for a query (a twelfth of a wide beam), queries searched at once, and queries of one audit.
EXPANDED, QUERIES, AUDITED = 8, 256, 64
#: Room for rounding of the single-precision search before the double-precision verification.
SLACK = 1e-3


@dataclass
class Graph:
    """The graph of a shard. x holds unit vectors; links[l][i] the neighbours of node i in layer l, -1 where none."""

    ids: np.ndarray
    copies: np.ndarray
    x: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)
    top: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.small = self.x.astype(np.float32)

    def build(self) -> Graph:
        """Inserts nodes from the highest layer down, in batches no larger than the graph so far: each batch searches the
        graph, adds its own members as candidates, and is linked both ways."""
        n = len(self.ids)
        draw = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 6)
        order = np.lexsort((np.arange(n), -level))
        height = int(level.max(initial=0))
        self.links = [np.full((n, LINKS0 if k == 0 else LINKS), -1) for k in range(height + 1)]
        self.top = order[:1]
        at = 0
        while at < n:
            batch = order[at : at + min(max(at, 32), QUERIES)]
            entry = np.repeat(self.top[None], len(batch), 0) if at else np.full((len(batch), 1), -1)
            for k in range(height, -1, -1):
                near, _ = self.search(self.small[batch], k, entry, BUILD_BEAM)
                members = level[batch] >= k
                if members.any():
                    self._link(k, batch[members], near[members])
                entry = near[:, :8]
            at += len(batch)
        self.top = order[:8]
        return self

    def _link(self, layer: int, batch: np.ndarray, near: np.ndarray) -> None:
        own = self.small[batch] @ self.small[batch].T
        np.fill_diagonal(own, -2)
        take = np.argsort(-own, axis=1)[:, : min(LINKS, len(batch) - 1)]
        links = self.links[layer]
        width = links.shape[1]
        chosen = self._diverse(batch, np.hstack([near, batch[take]]), width // 2 if layer == 0 else width)
        links[batch, : chosen.shape[1]] = chosen
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.small[source], self.small[target]), target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, counts)
        back = np.full((len(nodes), width), -1)
        some = nth < width
        back[np.repeat(np.arange(len(nodes)), counts)[some], nth[some]] = source[some]
        both = np.hstack([links[nodes], np.where((back[:, :, None] == links[nodes][:, None, :]).any(2), -1, back)])
        for k in range(0, len(nodes), QUERIES):
            part = slice(k, k + QUERIES)
            links[nodes[part]] = self._diverse(nodes[part], both[part], width)

    def _diverse(self, nodes: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
        """Of each node's candidates `keep` at most: first those nearer to the node than to any that is chosen already,
        which lead out of a dense group, then the nearest of the rest."""
        sims = np.where(near >= 0, np.einsum("ij,ikj->ik", self.small[nodes], self.small[near]), -np.inf)
        order = np.argsort(-sims, axis=1)[:, : keep * 2]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        between = np.einsum("ikj,ilj->ikl", self.small[near], self.small[near])
        picked, closest = np.zeros(near.shape, bool), np.full(near.shape, -np.inf)
        for k in range(near.shape[1]):
            picked[:, k] = (near[:, k] >= 0) & (sims[:, k] > closest[:, k])
            closest = np.where(picked[:, k, None], np.maximum(closest, between[:, :, k]), closest)
        rank = np.where(near < 0, 3, np.where(picked, 0, 1))
        order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.take_along_axis(near, order, 1)
        return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)

    def search(self, q: np.ndarray, layer: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the `beam` nearest nodes that a beam search of the layer meets, nearest first, and their cosines."""
        n, rows = len(q), np.arange(len(q))[:, None]
        ids, sims, done = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32), np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.ids) + 1), bool)
        new = entry
        while True:
            new = np.sort(new, axis=1)
            fresh = (new >= 0) & ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            width = max(1, int(fresh.sum(1).max(initial=0)))
            pick = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            new, fresh = np.take_along_axis(new, pick, 1), np.take_along_axis(fresh, pick, 1)
            found = np.where(fresh, np.einsum("qd,qkd->qk", q, self.small[new]), np.float32(-np.inf))
            ids, sims = np.hstack([ids, np.where(fresh, new, -1)]), np.hstack([sims, found])
            done = np.hstack([done, ~fresh])
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, best, 1) for a in (ids, sims, done))
            pick = np.argsort(done, axis=1, kind="stable")[:, : max(EXPANDED, beam // 12)]
            go = ~np.take_along_axis(done, pick, 1)
            if not go.any():
                return ids, sims
            np.put_along_axis(done, pick, True, 1)
            nodes = np.take_along_axis(ids, pick, 1)
            new = np.where(go[:, :, None], self.links[layer][nodes], -1).reshape(n, -1)

    def near(self, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine `threshold` or more, verified in double precision.

        A query whose whole beam is above the threshold is searched again with a wider one. Then some queries, those with
        the most links and others evenly chosen, are compared with every node: while one of them misses a link, all
        queries are searched again with twice the beam; a beam as wide as the shard meets all that can be reached.
        """
        single, beam, n = q.astype(np.float32), BEAM, len(self.ids)
        while True:
            one, other = self._beamed(single, np.arange(len(q)), min(beam, n), threshold)
            exact = np.einsum("ij,ij->i", q[one], self.x[other]) >= threshold
            one, other = one[exact], other[exact]
            found = np.bincount(one, minlength=len(q))
            audit = np.unique(np.concatenate([np.argsort(-found)[: AUDITED // 2], np.linspace(0, len(q) - 1, AUDITED // 2).astype(int)]))
            if (found[audit] == (q[audit] @ self.x.T >= threshold).sum(1)).all() or beam >= n:
                break
            beam *= 2
        if beam >= n:  # what no path reaches is compared as it stands
            one, other = np.nonzero(np.vstack([q[k : k + QUERIES] @ self.x.T for k in range(0, len(q), QUERIES)]) >= threshold)
        return one, other

    def _beamed(self, q: np.ndarray, which: np.ndarray, beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        ones, others = [], []
        for k in range(0, len(which), QUERIES):
            part = which[k : k + QUERIES]
            entry = np.repeat(self.top[None], len(part), 0)
            for layer in range(len(self.links) - 1, 0, -1):
                entry = self.search(q[part], layer, entry, BUILD_BEAM)[0][:, :16]
            ids, sims = self.search(q[part], 0, entry, beam)
            full = (sims[:, -1] >= threshold - SLACK) & (beam < len(self.ids))
            hit = (sims >= threshold - SLACK) & ~full[:, None]
            row, column = np.nonzero(hit)
            ones.append(part[row])
            others.append(ids[row, column])
            if full.any():
                more = self._beamed(q, part[full], min(beam * 4, len(self.ids)), threshold)
                ones.append(more[0])
                others.append(more[1])
        return (np.concatenate(ones), np.concatenate(others)) if ones else (np.zeros(0, int), np.zeros(0, int))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b the smallest node of each component, by repeated minima and shortcuts."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep")
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(rows["rep"].to_numpy(), rows["copies"].to_numpy(), x).build()
    first = rows.iloc[0]
    return pd.DataFrame([{"label": first["label"], "dim": first["dim"], "shards": first["shards"], "shard": first["shard"], "graph": pickle.dumps(graph)}])


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, left, right in zip(batch["i"], batch["j"], batch["left"], batch["right"]):
                one, other = pickle.loads(left), pickle.loads(right)
                a, b = other.near(one.x, threshold)
                n = len(one.ids)
                if i == j:
                    pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
                    a, b = pairs // n, pairs % n
                    a, b = a[a != b], b[a != b]
                    ids, copies = one.ids, one.copies
                else:
                    b = b + n
                    ids, copies = np.concatenate([one.ids, other.ids]), np.concatenate([one.copies, other.copies])
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                order = np.argsort(ids, kind="stable")  # so that the smallest node is the smallest id
                place = np.empty(len(ids), int)
                place[order] = np.arange(len(ids))
                root = ids[order][_roots(len(ids), place[a], place[b])][place]
                some = links > 0
                yield pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is `threshold` or more.
    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null vec_id
    (their component is null, kept false); vectors link within their length only. Equal vectors of a label are one node
    with a count, so copies cost nothing. The nodes of a label are dealt by hash into shards of about `shard`; each gets
    one graph and every pair of shards of a label is one search task, which returns for each node its number of links
    and the root of its links there, so output is a row per node and pair of shards, never the pairs of a group.
    vec_ids are taken to be distinct; rows that repeat one count as vectors of their own. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    nodes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("dim", F.size("embedding")))
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    n = sizes.agg(F.sum("shards"), F.sum(F.col("shards") * (F.col("shards") + 1) / 2)).first()
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), "shards"))
    dealt = dealt.repartition(2 * int(n[0] or 1), "label", "dim", "shard")
    graphs = stored(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, "label long, dim int, shards long, shard long, graph binary"))
    left = graphs.select("label", "dim", F.col("shard").alias("i"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("j"), F.col("graph").alias("left"))
    right = graphs.select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), "shard")).alias("i"), F.col("shard").alias("j"), F.col("graph").alias("right"))
    parts = 2 * int(n[1] or 1)
    pairs = left.repartition(parts, "label", "dim", "i", "j").join(right.repartition(parts, "label", "dim", "i", "j").hint("shuffle_hash"), ["label", "dim", "i", "j"])
    found = stored(pairs.select("i", "j", "left", "right").mapInPandas(_compare(threshold), "rep long, links long, root long"))
    roots = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = nodes.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
