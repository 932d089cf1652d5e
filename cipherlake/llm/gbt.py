"""Gradient-boosted trees for binary labels, kept as flat node arrays.

Trees are complete and stored in heap order, so scoring a batch is ``depth`` rounds of array
indexing for all rows and trees at once. Monotonic constraints hold by construction: a split
on a constrained feature must order its children's values, and the children's subtrees are
confined to either side of the middle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    feature: np.ndarray  # [trees, nodes], -1 where a node does not split
    threshold: np.ndarray  # [trees, nodes], right if x > threshold
    value: np.ndarray  # [trees, nodes]
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        total = np.full(x.shape[0], self.start)
        rows = np.arange(x.shape[0])
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(x.shape[0], np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node])
                node = np.where(f >= 0, go, node)
            total += value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 5.0, l2: float = 1.0) -> Forest:
    """Fit on all rows of x. With one class only, or no row, every score is that class's smoothed share."""
    n, k = x.shape
    monotone = np.zeros(k, int) if monotone is None else monotone
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:0], threshold[:0], value[:0], depth, start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)])
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node, low, high = np.zeros(n, np.int64), np.full(nodes, -4.0), np.full(nodes, 4.0)
        value[t, 0] = np.clip(-g.sum() / (h.sum() + l2), -4, 4)
        for level in range(depth):
            at, width = 2**level - 1, 2**level
            live = (node >= at) & (node < at + width)
            if not live.any():
                break
            local, gl, hl = node[live] - at, g[live], h[live]
            best, pick = np.full(width, 1e-3), np.zeros((width, 2), np.int64) - 1
            pair = np.zeros((width, 2))
            lo, hi = low[at : at + width, None], high[at : at + width, None]
            for j in range(k):
                m = edges[j].size
                if m == 0:
                    continue
                cell = local * (m + 1) + binned[j][live]
                left_g = np.bincount(cell, gl, width * (m + 1)).reshape(width, m + 1).cumsum(1)
                left_h = np.bincount(cell, hl, width * (m + 1)).reshape(width, m + 1).cumsum(1)
                sum_g, sum_h = left_g[:, -1:], left_h[:, -1:]
                left_g, left_h = left_g[:, :-1], left_h[:, :-1]
                right_g, right_h = sum_g - left_g, sum_h - left_h
                wl, wr = np.clip(-left_g / (left_h + l2), lo, hi), np.clip(-right_g / (right_h + l2), lo, hi)
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - sum_g**2 / (sum_h + l2)
                ok = (left_h >= least) & (right_h >= least)
                if monotone[j]:
                    ok &= (wr - wl) * monotone[j] >= 0
                gain = np.where(ok, gain, -1.0)
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                won = top > best
                best[won] = top[won]
                pick[won] = np.stack([np.full(width, j), b], 1)[won]
                pair[won] = np.stack([wl[np.arange(width), b], wr[np.arange(width), b]], 1)[won]
            for i in np.flatnonzero(pick[:, 0] >= 0):
                j, b = pick[i]
                here = at + i
                feature[t, here], threshold[t, here] = j, edges[j][b]
                for side in (0, 1):
                    child = 2 * here + 1 + side
                    value[t, child], low[child], high[child] = pair[i, side], low[here], high[here]
                if monotone[j]:
                    middle = pair[i].mean()
                    up, down = (2 * here + 2, 2 * here + 1) if monotone[j] > 0 else (2 * here + 1, 2 * here + 2)
                    low[up], high[down] = max(low[up], middle), min(high[down], middle)
            split = live & (feature[t, node] >= 0)
            f = feature[t, node[split]]
            node[split] = 2 * node[split] + 1 + (x[split, f] > threshold[t, node[split]])
        value[t] *= rate
        margin += value[t, node]
    return Forest(feature, threshold, value, depth, start)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block upper scores and their smoothed label shares, non-decreasing."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, label in zip(score[order], y[order]):
        if blocks and blocks[-1][2] == s:
            blocks[-1][0] += label
            blocks[-1][1] += 1
        else:
            blocks.append([float(label), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            hits, count, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + count, top]
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.02) / (b[1] + 0.5) for b in blocks])
