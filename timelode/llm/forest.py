"""A forest of random-projection trees: fitting on a bounded sample, best-first search of leaves.

Trees are perfect binary trees in heap order, held in two arrays, so their size depends on the parameters
only. numpy inside tasks; Spark does the partitioning (see `similar_vectors`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """planes (trees, 2^depth - 1, dim) of unit length, cuts (trees, 2^depth - 1)."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    @property
    def trees(self) -> int:
        return len(self.planes)

    @property
    def leaves(self) -> int:
        return 1 << self.depth


def fit_forest(sample: np.ndarray, *, trees: int, depth: int, seed: int = 7) -> Forest:
    """Each node separates two random points of its part of the sample, at the median of the projections.
    A node that has fewer than two different points gets a random plane through the origin."""
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    planes = rng.standard_normal((trees, nodes, dim)).astype(np.float32)
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    cuts = np.zeros((trees, nodes), np.float32)
    for t in range(trees):
        parts: list[np.ndarray] = [np.arange(len(sample))]
        for node in range(nodes):
            part = parts[node]
            if len(part) > 1:
                a, b = sample[rng.choice(part, 2, replace=False)]
                length = np.linalg.norm(a - b)
                if length > 0:
                    planes[t, node] = (a - b) / length
                at = sample[part] @ planes[t, node]
                cuts[t, node] = np.median(at)
                parts += [part[at < cuts[t, node]], part[at >= cuts[t, node]]]
            else:
                parts += [part, part[:0]]
    return Forest(planes, cuts, depth)


def search_leaves(forest: Forest, vectors: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `visits` leaves that a priority queue shared by all trees yields for each vector, and
    whether each is the vector's own leaf of its tree. Leaves are numbered tree * leaves + place.

    A node's priority is the largest distance to a plane that its path crosses. It never falls along a
    path and one child always keeps it, so the best `visits` nodes of a level contain all ancestors of the
    best `visits` leaves: the queue can be run level by level for a whole batch.
    """
    n, trees = len(vectors), forest.trees
    inner = (1 << forest.depth) - 1
    tree = np.broadcast_to(np.arange(trees), (n, trees))
    node = np.zeros((n, trees), np.int64)
    far = np.zeros((n, trees), np.float32)
    own = np.ones((n, trees), bool)
    flat, cuts = forest.planes.reshape(trees * inner, vectors.shape[1]), forest.cuts.reshape(-1)
    for _ in range(forest.depth):
        at = tree * inner + node
        margin = np.einsum("nd,nkd->nk", vectors, flat[at]) - cuts[at]
        right = margin >= 0
        miss = np.maximum(far, np.abs(margin))
        node = np.concatenate([2 * node + 1 + right, 2 * node + 2 - right], axis=1)
        far = np.concatenate([far, miss], axis=1)
        own = np.concatenate([own, np.zeros_like(own)], axis=1)
        tree = np.concatenate([tree, tree], axis=1)
        if node.shape[1] > visits:
            best = np.argpartition(far - own, visits - 1, axis=1)[:, :visits]
            node, far, own, tree = (np.take_along_axis(x, best, axis=1) for x in (node, far, own, tree))
    return tree * forest.leaves + node - inner, own
