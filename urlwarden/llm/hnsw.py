"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

All searches of a batch go through the graph in step: each round expands the best nodes of every
query with a few array operations.
"""

from __future__ import annotations

import numpy as np

BATCH = 256
WIDE = 4  # nodes of a query expanded per round


class Graph:
    """links[l] is (n x degree) of neighbours on layer l, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.x = vectors
        self.f = vectors.astype(np.float32)
        self.links, self.entry = links, entry

    @staticmethod
    def build(vectors: np.ndarray, degree: int = 16, beam: int = 48, seed: int = 11) -> Graph:
        """vectors: unit rows. Nodes enter in batches no larger than what is already in."""
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(degree)).astype(int)
        level[0] = max(level.max(initial=0), 0) if n else 0
        top = int(level[0]) if n else 0
        links = [np.full((n, degree * (2 if layer == 0 else 1)), -1, dtype=np.int32) for layer in range(top + 1)]
        g = Graph(vectors, links, 0)
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(BATCH, done)))
            at = np.zeros((len(new), 1), dtype=np.int32)
            for layer in range(top, -1, -1):
                mine = level[new] >= layer
                ids, _ = g.search(g.f[new], layer, at, beam if mine.any() else 1)
                at = ids[:, :1]
                if mine.any():
                    g._insert(new[mine], ids[mine], layer)
            done = int(new[-1]) + 1
        return g

    def _insert(self, new: np.ndarray, near: np.ndarray, layer: int) -> None:
        links, degree = self.links[layer], self.links[layer].shape[1]
        peers = self.f[new] @ self.f[new].T
        np.fill_diagonal(peers, -2)
        k = min(degree, len(new) - 1)
        close = np.argsort(-peers, axis=1, kind="stable")[:, :k] if k else np.zeros((len(new), 0), dtype=int)
        mates = np.where(np.take_along_axis(peers, close, axis=1) > -2, new[close], -1) if k else close
        chosen = self._diverse(new, np.concatenate((near, mates.astype(np.int32)), axis=1), degree // 2 if layer == 0 else degree)
        links[new, : chosen.shape[1]] = chosen
        # the way back: each chosen node gets the new ones as neighbours
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(nodes), BATCH):
            part = slice(at, at + BATCH)
            most = int(count[part].max())
            more = np.full((len(nodes[part]), most), -1, dtype=np.int32)
            for r, (a, c) in enumerate(zip(first[part], count[part])):
                more[r, :c] = src[a : a + c]
            links[nodes[part]] = self._fill(self._diverse(nodes[part], np.concatenate((links[nodes[part]], more), axis=1), degree), degree)

    @staticmethod
    def _fill(rows: np.ndarray, width: int) -> np.ndarray:
        out = np.full((len(rows), width), -1, dtype=np.int32)
        out[:, : rows.shape[1]] = rows
        return out

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """At most `most` candidates of each node: nearest first, those nearer to a chosen one than
        to the node last, so links lead out of dense groups too."""
        c = np.sort(candidates, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == nodes[:, None]] = -1
        sim = np.where(c >= 0, np.einsum("bd,bkd->bk", self.f[nodes], self.f[c]), -2).astype(np.float32)
        order = np.argsort(-sim, axis=1, kind="stable")[:, : most * 3]
        c, sim = np.take_along_axis(c, order, axis=1), np.take_along_axis(sim, order, axis=1)
        between = np.einsum("bkd,bjd->bkj", self.f[c], self.f[c])
        chosen = np.zeros(c.shape, dtype=bool)
        for k in range(c.shape[1]):
            nearer = np.where(chosen, between[:, k], -2).max(axis=1, initial=-2)
            chosen[:, k] = (c[:, k] >= 0) & (nearer < sim[:, k])
        rank = np.where(c < 0, 3, np.where(chosen, 0, 1)) * 10.0 - sim
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(c, pick, axis=1)

    def search(self, queries: np.ndarray, layer: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best `beam` nodes found for each query, best first, -1 padded."""
        n, b, links = len(self.f), len(queries), self.links[layer]
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), dtype=bool)
        ids = np.full((b, beam), -1, dtype=np.int32)
        sim = np.full((b, beam), -2, dtype=np.float32)
        w = min(beam, start.shape[1])
        ids[:, :w] = start[:, :w]
        sim[:, :w] = np.where(ids[:, :w] >= 0, np.einsum("bd,bkd->bk", queries, self.f[ids[:, :w]]), -2)
        r, c = np.nonzero(ids[:, :w] >= 0)
        seen[r, ids[r, c]] = True
        fresh = ids >= 0
        live = np.arange(b)
        while len(live):
            k = min(WIDE, beam)
            score = np.where(fresh[live], sim[live], -3)
            pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(score, pick, axis=1) > -3
            some = ok.any(axis=1)
            live, pick, ok = live[some], pick[some], ok[some]
            if not len(live):
                break
            node = np.where(ok, ids[live[:, None], pick], -1)
            fresh[live[:, None], pick] = False
            near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            keep = int((near >= 0).sum(axis=1).max(initial=0))
            if keep == 0:
                continue
            near = np.sort(near, axis=1)[:, -keep:]
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -2, dtype=np.float32)
            s[r, c] = np.einsum("ed,ed->e", queries[live[r]], self.f[near[r, c]])
            every, value = np.concatenate((ids[live], near), axis=1), np.concatenate((sim[live], s), axis=1)
            state = np.concatenate((fresh[live], near >= 0), axis=1)
            order = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
            ids[live], sim[live] = np.take_along_axis(every, order, axis=1), np.take_along_axis(value, order, axis=1)
            fresh[live] = np.take_along_axis(state, order, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return ids[rows, order], sim[rows, order]

    def within(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Nodes at least that similar to each unit query, as found: a beam that ends full of them
        is doubled until it holds others too, or all nodes."""
        found: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(queries)
        f = queries.astype(np.float32)
        for at in range(0, len(f), BATCH):
            part = np.arange(at, min(at + BATCH, len(f)))
            start = np.full((len(part), 1), self.entry, dtype=np.int32)
            for layer in range(len(self.links) - 1, 0, -1):
                start = self.search(f[part], layer, start, 4)[0]
            width = beam
            while len(part):
                ids, sim = self.search(f[part], 0, start, min(width, len(self.f)))
                full = (sim[:, -1] >= least - 0.02) & (width < len(self.f))
                for r in np.flatnonzero(~full):
                    near = ids[r][(sim[r] >= least - 1e-3) & (ids[r] >= 0)]
                    found[part[r]] = near[self.x[near] @ queries[part[r]] >= least]
                part, start, width = part[full], ids[full], width * 2
        return found
