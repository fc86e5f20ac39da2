"""Two-dimensional kernels on NumPy arrays: paths, labels, fills, blurs, similarity, Poisson."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np


def dijkstra(start: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], nodes: int, goal: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and predecessors over undirected edges (from, to, weight); stops at ``goal``."""
    a, b, w = edges
    ends, other, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(ends, kind="stable")
    other, weight = other[order].tolist(), weight[order].tolist()
    first = np.searchsorted(ends[order], np.arange(nodes + 1)).tolist()
    dist, back, done = [float("inf")] * nodes, [-1] * nodes, bytearray(nodes)
    dist[start] = 0.0
    heap = [(0.0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if done[x]:
            continue
        done[x] = 1
        if x == goal:
            break
        for k in range(first[x], first[x + 1]):
            y, nd = other[k], d + weight[k]
            if nd < dist[y]:
                dist[y], back[y] = nd, x
                heapq.heappush(heap, (nd, y))
    return np.array(dist), np.array(back)


def path(back: np.ndarray, goal: int) -> list[int]:
    out = [goal]
    while back[out[-1]] >= 0:
        out.append(int(back[out[-1]]))
    return out[::-1]


def shortest_steps(grid: np.ndarray, start: tuple[int, int], wall: int, goal: int) -> list[tuple[int, int]] | None:
    """A 4-connected path of (col, row) from start to the first cell that holds ``goal``, or None."""
    height, width = grid.shape
    seen, queue = {start: None}, deque([start])
    while queue:
        x, y = at = queue.popleft()
        if grid[y, x] == goal:
            out = []
            while at is not None:
                out.append(at)
                at = seen[at]
            return out[::-1]
        for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= p[0] < width and 0 <= p[1] < height and p not in seen and grid[p[1], p[0]] != wall:
                seen[p] = at
                queue.append(p)
    return None


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers from 1 in scanning order; 0 where the mask is not set."""
    height, width = mask.shape
    root = np.where(mask > 0, np.arange(mask.size).reshape(mask.shape), mask.size)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    pairs = []
    for dr, dc in steps:
        a = (slice(0, height - dr), slice(max(0, -dc), width - max(0, dc)))
        b = (slice(dr, height), slice(max(0, dc), width - max(0, -dc)))
        both = (mask[a] > 0) & (mask[b] > 0)
        pairs.append((np.arange(mask.size).reshape(mask.shape)[a][both], np.arange(mask.size).reshape(mask.shape)[b][both]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    flat = np.append(root.reshape(-1), mask.size)
    while len(i):
        low = flat.copy()
        least = np.minimum(flat[i], flat[j])
        np.minimum.at(low, flat[i], least)
        np.minimum.at(low, flat[j], least)
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == flat).all():
            break
        flat = low
    out = np.zeros(mask.size, np.int64)
    set_ = np.flatnonzero(mask.reshape(-1) > 0)
    out[set_] = np.unique(flat[set_], return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def flood(grid: np.ndarray, seed: tuple[int, int], value: int) -> np.ndarray:
    """``grid`` with the 4-connected area of equal cells around the seed (row, col) set to ``value``."""
    same = label(grid == grid[seed], eight=False)
    return np.where(same == same[seed], value, grid)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with every area that its outside does not reach (4-connected)."""
    frame = np.pad(mask > 0, 1)
    out = label(~frame, eight=False)
    return (out != out[0, 0])[1:-1, 1:-1].astype(mask.dtype)


def blur(mask: np.ndarray, taps: list[int]) -> np.ndarray:
    """Separable integer blur with a reflected border (edge not repeated)."""
    half = len(taps) // 2
    out = mask.astype(np.int64)
    for axis in (1, 0):
        pad = np.pad(out, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="reflect")
        n = out.shape[axis]
        out = sum(t * np.take(pad, np.arange(k, k + n), axis) for k, t in enumerate(taps))
    return out


def feather(mask: np.ndarray, size: int = 57) -> np.ndarray:
    """Weights of a binary mask, multiples of 1 / (size + 1)."""
    from tessera.operators.focal import gaussian_taps

    total = blur((mask > 0) * (size + 1), gaussian_taps(size))
    return (((total + (1 << 31)) >> 32) / (size + 1)).astype(np.float32)


def adaptive_feather(mask: np.ndarray, sizes: tuple[int, int] = (65, 25)) -> np.ndarray:
    """The wide feather, or the narrow one if the wide one does not leave the border at 0."""
    for size in sizes:
        w = feather(mask, size)
        if not (w[0].any() or w[-1].any() or w[:, 0].any() or w[:, -1].any()):
            break
    return w


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    """The least value over size by size; the mask's frame, and what lies outside, is 0."""
    inner = np.zeros_like(mask)
    inner[1:-1, 1:-1] = mask[1:-1, 1:-1]
    half = size // 2
    for axis in (0, 1):
        pad = np.pad(inner, [(half, size - 1 - half) if k == axis else (0, 0) for k in (0, 1)])
        total = np.cumsum(pad > 0, axis=axis, dtype=np.int64)
        total = np.insert(total, 0, 0, axis=axis)
        n = inner.shape[axis]
        inner = ((np.take(total, np.arange(size, size + n), axis) - np.take(total, np.arange(n), axis)) == size).astype(mask.dtype)
    return inner


def dilated(values: np.ndarray, size: int) -> np.ndarray:
    """The greatest value over size by size, anchored at size // 2."""
    half = size // 2
    for axis in (0, 1):
        pad = np.pad(values, [(half, size - 1 - half) if k == axis else (0, 0) for k in (0, 1)])
        values = np.lib.stride_tricks.sliding_window_view(pad, size, axis=axis).max(axis=-1)
    return values


def ssim(a: np.ndarray, b: np.ndarray, size: int = 7, full: int = 255) -> float:
    """Mean structural similarity of two stacks (row, col, band); uniform windows, sample covariance."""
    if min(a.shape[:2]) < size:
        raise ValueError("a side is shorter than the window")
    n = size * size

    def sums(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.astype(np.int64), ((1, 0), (1, 0), (0, 0))).cumsum(0).cumsum(1)
        return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]

    x, y = a.astype(np.int64), b.astype(np.int64)
    sa, sb, saa, sbb, sab = sums(x), sums(y), sums(x * x), sums(y * y), sums(x * y)
    c1, c2 = (0.01 * full) ** 2, (0.03 * full) ** 2
    ma, mb, k = sa / n, sb / n, n / (n - 1)
    va, vb, vab = k * (saa / n - ma * ma), k * (sbb / n - mb * mb), k * (sab / n - ma * mb)
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean((0, 1)).mean())


def poisson(source: np.ndarray, target: np.ndarray, mask: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """The source's gradients inside the mask, the target's values on its edge (conjugate gradient, until
    the mean residual is below the tolerance; more rounds than ten times the cells are an error).

    ``source`` and ``target``: (row, col) of one band. The grid's outer frame always keeps the target.
    """
    inside = mask > 0
    inside = inside.copy()
    inside[[0, -1]] = False
    inside[:, [0, -1]] = False
    s, out = source.astype(np.float64), target.astype(np.float64).copy()
    if not inside.any():
        return out

    def laplace(v: np.ndarray) -> np.ndarray:
        r = 4 * v
        r[1:] -= v[:-1]
        r[:-1] -= v[1:]
        r[:, 1:] -= v[:, :-1]
        r[:, :-1] -= v[:, 1:]
        return r

    edge = np.where(inside, 0.0, out)
    rhs = np.where(inside, laplace(s) - laplace(edge), 0.0)
    x = np.where(inside, s, 0.0)
    res = np.where(inside, rhs - laplace(x), 0.0)
    p, rr = res.copy(), float((res * res).sum())
    stop = tolerance * tolerance * inside.sum()
    left = 10 * int(inside.sum()) + 100
    while rr > stop:
        if not left:
            raise RuntimeError("the fill does not converge")
        left -= 1
        ap = np.where(inside, laplace(p), 0.0)
        step = rr / float((p * ap).sum())
        x += step * p
        res -= step * ap
        new = float((res * res).sum())
        p = res + new / rr * p
        rr = new
    return np.where(inside, x, out)
