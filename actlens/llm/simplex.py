"""N-simplex projection: distances to a few pivots as coordinates that bound all other distances.

The pivots span a simplex. An object with known distances to them is the apex of a
simplex over that base: its place within the base's hull, and its height above it.
Two apexes on the same side of the base are at least as near as their objects, on
opposite sides at least as far, so two Euclidean distances bound the true one.
"""

from __future__ import annotations

import numpy as np

# A pivot nearer than this share of its distance to the hull of those before adds no useful
# coordinate and would let rounding grow.
FLAT = 1e-2
# Slack of a bound, as a share of the lengths it is made of: a height is the root of
# a difference of squares, which keeps about half of a double's digits.
SLACK = 1e-6


class Simplex:
    """Base simplex over ``pivots`` (integer vectors), as a lower-triangular table of vertices."""

    def __init__(self, pivots: np.ndarray):
        chosen: list[np.ndarray] = []
        base = np.zeros((0, 0))
        for pivot in pivots:
            if not chosen:
                chosen.append(pivot)
                continue
            self.pivots, self.base = np.stack(chosen), base
            apex = self.apexes(self.distances(pivot[None]))[0]
            if apex[-1] > FLAT * np.linalg.norm(apex):
                base = np.pad(base, ((0, 1), (0, 1)))
                base[-1] = apex
                chosen.append(pivot)
        self.pivots, self.base = np.stack(chosen), base

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances of integer vectors to the pivots, exact, one column each."""
        out = np.empty((len(vectors), len(self.pivots)), np.int64)
        for i, pivot in enumerate(self.pivots):
            gap = vectors - pivot
            out[:, i] = np.einsum("ij,ij->i", gap, gap)
        return out

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots: one per vertex but the first, then the height."""
        squares = squares.astype(float)
        first = squares[:, 0]
        out = np.zeros((len(squares), len(self.base) + 1))
        for i, vertex in enumerate(self.base):
            # |x|^2 - |x - vertex|^2 = 2 <x, vertex> - |vertex|^2, solved for coordinate i.
            known = out[:, :i] @ vertex[:i]
            out[:, i] = ((first - squares[:, i + 1] + vertex @ vertex) / 2 - known) / vertex[i]
        height = first - np.einsum("ij,ij->i", out[:, :-1], out[:, :-1])
        out[:, -1] = np.sqrt(np.maximum(height, 0))
        return out


def candidates(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each object: rows x centroids, from their apexes.

    A centroid goes when its lower bound is above the least upper bound of all.
    """
    flat = np.zeros((len(apexes), len(centroids)))
    for c, centroid in enumerate(centroids):
        gap = apexes[:, :-1] - centroid[:-1]
        flat[:, c] = np.einsum("ij,ij->i", gap, gap)
    lower = np.sqrt(flat + (apexes[:, -1:] - centroids[:, -1]) ** 2)
    upper = np.sqrt(flat + (apexes[:, -1:] + centroids[:, -1]) ** 2)
    size = np.linalg.norm(apexes, axis=1) + np.linalg.norm(centroids, axis=1).max()
    return lower <= (upper.min(axis=1) + SLACK * size)[:, None]


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties to the smaller number), its squared distance, and the comparisons made.

    Integer distances are taken only to the candidates.
    """
    may = candidates(apexes, tops)
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    cluster = np.zeros(len(vectors), np.int64)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero(may[:, c])
        gap = vectors[rows] - centroid
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = distance < best[rows]
        best[rows[closer]] = distance[closer]
        cluster[rows[closer]] = c
    return cluster, best, int(may.sum())
