"""A hierarchical navigable small-world graph in flat numpy arrays, built and searched in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16
BEAM = 64
BATCH = 256


@dataclass
class Graph:
    """``layers[l][i]`` lists the neighbours of node ``i`` on layer ``l`` (-1: none); ``entry`` is on the top one."""

    vectors: np.ndarray  # unit length, float32
    layers: list[np.ndarray]
    entry: int

    def search_layer(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, similarities), best first, -1 where fewer were found."""
        links, n_queries, width = self.layers[layer], len(queries), entries.shape[1]
        seen = np.zeros((n_queries, len(self.vectors)), bool)
        ids = np.full((n_queries, beam), -1)
        near = np.full((n_queries, beam), -np.inf, np.float32)
        done = np.zeros((n_queries, beam), bool)
        width = min(width, beam)
        ids[:, :width] = entries[:, :width]
        got = ids[:, :width] >= 0
        sims = np.einsum("qwd,qd->qw", self.vectors[ids[:, :width]], queries)
        near[:, :width] = np.where(got, sims, -np.inf)
        rows, cols = np.nonzero(got)
        seen[rows, ids[rows, cols]] = True
        while True:
            open_near = np.where(done, -np.inf, near)
            best = open_near.argmax(1)
            active = np.flatnonzero(open_near[np.arange(n_queries), best] > -np.inf)
            if not len(active):
                order = np.argsort(-near, axis=1, kind="stable")
                return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            done[active, best[active]] = True
            next_ids = links[ids[active, best[active]]]
            fresh = (next_ids >= 0) & ~seen[active[:, None], next_ids]
            rows, cols = np.nonzero(fresh)
            seen[active[rows], next_ids[rows, cols]] = True
            sims = np.einsum("qwd,qd->qw", self.vectors[next_ids], queries[active])
            all_ids = np.concatenate([ids[active], np.where(fresh, next_ids, -1)], 1)
            all_near = np.concatenate([near[active], np.where(fresh, sims, -np.inf)], 1)
            all_done = np.concatenate([done[active], np.zeros(fresh.shape, bool)], 1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            near[active] = np.take_along_axis(all_near, top, 1)
            done[active] = np.take_along_axis(all_done, top, 1)

    def search(self, queries: np.ndarray, beam: int, bottom: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """From the entry down to layer ``bottom``."""
        entries = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, bottom, -1):
            entries = self.search_layer(queries, entries, layer, min(beam, 8))[0]
        return self.search_layer(queries, entries, bottom, beam)

    def choose(self, nodes: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """``most`` neighbours per node out of candidates sorted by similarity.

        A candidate that is nearer to a chosen one than to the node comes after all
        others, so that links lead into different directions.
        """
        vectors = self.vectors[ids]
        between = np.einsum("nad,nbd->nab", vectors, vectors)
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            hidden = (chosen & (between[:, k, :] > near[:, k, None])).any(1)
            chosen[:, k] = (near[:, k] > -np.inf) & ~hidden & (chosen.sum(1) < most)
        rank = np.where(near > -np.inf, np.where(chosen, 0, 1), 2) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(near, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def link(self, nodes: np.ndarray, ids: np.ndarray, near: np.ndarray, layer: int) -> None:
        """Links of new nodes, and back."""
        links = self.layers[layer]
        most = links.shape[1]
        links[nodes] = self.choose(nodes, ids, near, most)
        source = np.repeat(nodes, most)
        target = links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hubs, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(hubs), 512):
            some = slice(at, at + 512)
            hub, start, n = hubs[some], first[some], count[some]
            wide = np.full((len(hub), most + int(n.max())), -1)
            wide[:, :most] = links[hub]
            for k in range(int(n.max())):
                more = n > k
                wide[more, most + k] = source[start[more] + k]
            # A new node may have been linked already (it lies in the same batch).
            same = (wide[:, most:, None] == wide[:, None, :most]).any(2)
            wide[:, most:][same] = -1
            sims = np.where(wide >= 0, np.einsum("nwd,nd->nw", self.vectors[wide], self.vectors[hub]), -np.inf)
            by_near = np.argsort(-sims, axis=1, kind="stable")
            links[hub] = self.choose(
                hub, np.take_along_axis(wide, by_near, 1), np.take_along_axis(sims, by_near, 1).astype(np.float32), most
            )


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BEAM, batch: int = BATCH, seed: int = 42) -> Graph:
    """Insert all vectors, in batches that double up to ``batch``; the order is the order of rows."""
    vectors = np.ascontiguousarray(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.float32)
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    level = np.minimum((-np.log(1 - draws) / np.log(links)).astype(int), 12)
    # Nodes of high layers first: the entry exists before all others.
    order = np.argsort(-level, kind="stable")
    graph = Graph(
        vectors,
        [np.full((n, links * (1 + (layer == 0))), -1) for layer in range(level.max() + 1)],
        int(order[0]),
    )
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        for layer in range(level[new].max(), -1, -1):
            nodes = new[level[new] >= layer]
            ids, near = graph.search(vectors[nodes], beam, layer)
            inside = vectors[nodes] @ vectors[nodes].T
            np.fill_diagonal(inside, -np.inf)
            best = np.argsort(-inside, axis=1)[:, : min(links, len(nodes))]
            ids = np.concatenate([ids, nodes[best]], 1)
            near = np.concatenate([near, np.take_along_axis(inside, best, 1)], 1)
            by_near = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            graph.link(nodes, np.take_along_axis(ids, by_near, 1), np.take_along_axis(near, by_near, 1), layer)
        at += size
        size = min(size * 2, batch)
    return graph
