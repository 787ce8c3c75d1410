"""Hierarchical navigable small-world graphs in numpy, with many searches in step.

A graph is built by inserting points in batches: each point is linked to diverse near points on its level and
below. ``within`` searches greedily from the top, then with a beam, and then follows links through all points
that are similar enough, so that the size of a group of near copies sets no limit on what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LINKS = 12
BUILD_BEAM, BEAM = 48, 24
AT_ONCE = 4  # points that a search expands in one step
BATCH = 256


@dataclass
class Graph:
    """Unit vectors, and for each level, from 0 up, the links of every point (-1 where there is none)."""

    vectors: np.ndarray
    links: list[np.ndarray]
    entry: int

    def _beam(self, queries: np.ndarray, entries: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``width`` most similar points found, with their similarities, best first."""
        n, many = len(self.vectors), np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), n + 1), bool)
        seen[:, n] = True
        ids = np.full((len(queries), width), n)
        sims = np.full((len(queries), width), -2.0, np.float32)
        open_ = np.zeros((len(queries), width), bool)
        ids[:, 0], open_[:, 0], seen[many[:, 0], entries] = entries, True, True
        sims[:, 0] = (queries * self.vectors[entries]).sum(axis=1)
        take = min(AT_ONCE, width)
        while True:
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                return ids, sims
            at = many[:len(rows)]
            best = np.argsort(~open_[rows], axis=1, kind="stable")[:, :take]  # sorted by similarity already
            chosen = np.where(open_[rows[:, None], best], ids[rows[:, None], best], n)
            open_[rows[:, None], best] = False
            near = np.where((chosen < n)[:, :, None], self.links[level][np.minimum(chosen, n - 1)], -1)
            near = np.sort(near.reshape(len(rows), -1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows[:, None], near]] = n  # -1 is the last column too
            near[near < 0] = n
            seen[rows[:, None], near] = True
            new = np.einsum("qd,qkd->qk", queries[rows], self.vectors[np.minimum(near, n - 1)])
            new[near == n] = -2.0
            all_sims = np.concatenate([sims[rows], new], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[rows] = np.concatenate([ids[rows], near], axis=1)[at, order]
            sims[rows] = all_sims[at, order]
            fresh = np.concatenate([open_[rows], near < n], axis=1)
            open_[rows] = fresh[at, order]

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        entries = np.full(len(queries), self.entry)
        for upper in range(len(self.links) - 1, level, -1):
            entries = self._beam(queries, entries, upper, 1)[0][:, 0]
        return entries

    def within(self, queries: np.ndarray, least: float, beam: int = BEAM, slack: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all points found with a similarity of at least ``least``, for the exact check to
        follow. Points down to ``least - slack`` are passed through on the way."""
        parts = list(self.blocks(queries, least, beam, slack))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts)]) for i in (0, 1))

    def blocks(self, queries: np.ndarray, least: float, beam: int = BEAM, slack: float = 0.02) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for ``BATCH`` queries after another, so that no more pairs are held than they have points."""
        n = len(self.vectors)
        for first in range(0, len(queries), BATCH):
            found_q, found_p = [], []
            part = queries[first:first + BATCH]
            ids, sims = self._beam(part, self._descend(part, 0), 0, beam)
            seen = np.zeros(len(part) * n, bool)
            q, spot = np.nonzero((sims >= least - slack) & (ids < n))
            p, s = ids[q, spot], sims[q, spot]
            seen[q * n + p] = True
            while len(q):
                good = s >= least
                found_q.append(q[good] + first)
                found_p.append(p[good])
                next_q, next_p, next_s = [], [], []
                for a in range(0, len(q), 1 << 16):
                    near = self.links[0][p[a:a + (1 << 16)]]
                    key = (q[a:a + (1 << 16), None] * n + near)[near >= 0]
                    key = np.unique(key[~seen[key]])
                    seen[key] = True
                    kq, kp = key // n, key % n
                    ks = np.concatenate([np.einsum("kd,kd->k", part[kq[b:b + 65_536]], self.vectors[kp[b:b + 65_536]])
                                         for b in range(0, len(key), 65_536)] or [np.zeros(0, np.float32)])
                    keep = ks >= least - slack
                    next_q.append(kq[keep])
                    next_p.append(kp[keep])
                    next_s.append(ks[keep])
                q, p, s = map(np.concatenate, (next_q, next_p, next_s))
            if found_q:
                yield np.concatenate(found_q), np.concatenate(found_p)


def _diverse(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by similarity, those that are nearer to the point than to any chosen before;
    free places go to the nearest of the rest."""
    rows, width = ids.shape
    n = len(vectors)
    known = vectors[np.minimum(ids, n - 1)]
    between = np.einsum("qad,qbd->qab", known, known)
    chosen = np.zeros((rows, width), bool)
    for k in range(width):
        blocked = ((between[:, k, :] > sims[:, k, None]) & chosen).any(axis=1)
        chosen[:, k] = (ids[:, k] < n) & ~blocked & (chosen.sum(axis=1) < most)
    order = np.argsort(np.where(chosen, 0, np.where(ids < n, 1, 2)), axis=1, kind="stable")[:, :most]
    picked = np.take_along_axis(ids, order, axis=1)
    out = np.full((rows, most), -1)
    out[:, :picked.shape[1]] = np.where(picked < n, picked, -1)
    return out


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """A graph over unit vectors (rows of float32); the same rows always give the same graph."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.minimum(-np.log(1 - rng.random(n)) / np.log(LINKS), 12).astype(int)
    order = rng.permutation(n)
    # The points of the highest level first, so that upper levels are whole before the mass comes in.
    order = order[np.argsort(-level[order], kind="stable")]
    graph = Graph(vectors, [np.full((n, LINKS * (2 if x == 0 else 1)), -1) for x in range(level.max(initial=0) + 1)],
                  int(order[0]) if n else -1)
    done, size = min(1, n), 1
    while done < n:
        batch = order[done:done + size]
        for x in range(level[batch].max(), -1, -1):
            _insert(graph, batch[level[batch] >= x], x)
        done += len(batch)
        size = min(BATCH, 2 * size)
    return graph


def _insert(graph: Graph, points: np.ndarray, level: int) -> None:
    vectors, links, n = graph.vectors, graph.links[level], len(graph.vectors)
    own = vectors[points]
    ids, sims = graph._beam(own, graph._descend(own, level), level, BUILD_BEAM)
    # Points of one batch do not find each other in the graph, so they are compared directly.
    among = own @ own.T
    np.fill_diagonal(among, -2.0)
    near = np.argsort(-among, axis=1)[:, :LINKS]
    ids = np.concatenate([ids, points[near]], axis=1)
    sims = np.concatenate([sims, np.take_along_axis(among, near, axis=1)], axis=1)
    ids[sims <= -2.0] = n
    best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
    ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
    links[points, :LINKS] = _diverse(sims, ids, vectors, LINKS)
    # Links back: the nodes that were linked to choose again among what they have and what is new.
    source = np.repeat(points, LINKS)
    target = links[points, :LINKS].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    place = np.argsort(target, kind="stable")
    source, target = source[place], target[place]
    nodes, start, many = np.unique(target, return_index=True, return_counts=True)
    width = links.shape[1]
    for a in range(0, len(nodes), 512):
        some, count = nodes[a:a + 512], many[a:a + 512]
        extra = np.full((len(some), int(count.max())), -1)
        column = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        extra[np.repeat(np.arange(len(some)), count), column] = source[start[a]:start[a] + count.sum()]
        have = np.sort(np.concatenate([links[some], extra], axis=1), axis=1)
        have[:, 1:][have[:, 1:] == have[:, :-1]] = -1
        there = np.where(have >= 0, np.einsum("qd,qkd->qk", vectors[some], vectors[np.maximum(have, 0)]), -2.0)
        best = np.argsort(-there, axis=1, kind="stable")[:, :BUILD_BEAM]
        have, there = np.take_along_axis(have, best, axis=1), np.take_along_axis(there, best, axis=1)
        links[some] = _diverse(there, np.where(have >= 0, have, n), vectors, width)
