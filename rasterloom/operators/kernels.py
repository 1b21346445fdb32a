"""Kernels on whole scenes: operators that need a 2-D array at once run one scene to a task.

per_scene() lays a scene's rows out as an array, calls a numpy function and returns its cells.  A scene must fit
a task, so large ones are cut into tiles first (geom.tile), with overlaps as wide as the kernel reaches.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_scene(df: DataFrame, fn, v: str = "v", by=("scene",), out: str = "v") -> DataFrame:
    """(by, y, x, out) of fn(array of v), NaN where there is no row."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        a = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan)
        a[y - y0, x - x0] = pdf[v].to_numpy(float)
        r = np.asarray(fn(a), float)
        return pd.DataFrame({**{b: pdf[b] for b in by}, "y": y, "x": x, out: r[y - y0, x - x0]})

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], f"y {kinds['y']}", f"x {kinds['x']}", f"{out} double"])
    return df.select(*by, "y", "x", F.col(v).cast("double").alias(v)).groupBy(*by).applyInPandas(run, schema)


def _pad(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, n, mode="edge")


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, edges repeated."""
    n = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    p = np.pad(a, ((n, n), (0, 0)), mode="edge")
    p = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k))
    p = np.pad(p, ((0, 0), (n, n)), mode="edge")
    return sum(w * p[:, i : i + a.shape[1]] for i, w in enumerate(k))


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.gradient(a))


def structure_tensor(a: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Larger and smaller eigenvalue of the smoothed gradient tensor."""
    gy, gx = gradient(a)
    yy, xx, xy = gaussian(gy * gy, sigma), gaussian(gx * gx, sigma), gaussian(gx * gy, sigma)
    m, d = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
    return m + d, m - d


def corner_harris(a: np.ndarray, k: float = 0.05, sigma: float = 1.0) -> np.ndarray:
    big, small = structure_tensor(a, sigma)
    return big * small - k * (big + small) ** 2


def laplacian_of_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    g = _pad(gaussian(a, sigma), 1)
    return sigma**2 * (g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * g[1:-1, 1:-1])


def blobs(a: np.ndarray, sigmas, response, threshold: float) -> np.ndarray:
    """The scale of a blob at its centre, else 0: maxima over space and scale of a response above the threshold."""
    cube = np.stack([response(a, s) for s in sigmas])
    p = np.pad(cube, 1, mode="constant", constant_values=-np.inf)
    top = np.max([p[i : i + cube.shape[0], j : j + cube.shape[1], k : k + cube.shape[2]] for i in range(3) for j in range(3) for k in range(3)], 0)
    hit = (cube == top) & (cube > threshold)
    return np.where(hit.any(0), np.asarray(sigmas)[hit.argmax(0)], 0.0)


def blob_log(a, sigmas=(1, 2, 4), threshold=0.2):
    return blobs(a, sigmas, lambda x, s: -laplacian_of_gaussian(x, s), threshold)


def blob_dog(a, sigmas=(1, 2, 4), threshold=0.2, ratio=1.6):
    return blobs(a, sigmas, lambda x, s: (gaussian(x, s) - gaussian(x, s * ratio)) / (ratio - 1), threshold)


def blob_doh(a, sigmas=(1, 2, 4), threshold=0.01):
    def det(x, s):
        gy, gx = gradient(gaussian(x, s))
        (yy, yx), (_, xx) = gradient(gy), gradient(gx)
        return s**4 * (yy * xx - yx**2)

    return blobs(a, sigmas, det, threshold)


def canny(a: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Gradient maxima along the gradient above `low` that touch one above `high`."""
    gy, gx = gradient(gaussian(a, sigma))
    m = np.hypot(gy, gx)
    p = _pad(m, 1)
    dy, dx = np.rint(gy / np.maximum(m, 1e-12)).astype(int), np.rint(gx / np.maximum(m, 1e-12)).astype(int)
    i, j = np.indices(a.shape)
    ridge = (m >= p[i + 1 + dy, j + 1 + dx]) & (m >= p[i + 1 - dy, j + 1 - dx]) & (m >= low)
    out = ridge & (m >= high)
    while True:
        q = np.pad(out, 1)
        grown = ridge & np.max([q[r : r + a.shape[0], c : c + a.shape[1]] for r in range(3) for c in range(3)], 0)
        if (grown == out).all():
            return out
        out = grown


def hog(a: np.ndarray, bins: int = 9, cell: int = 8) -> np.ndarray:
    """(cells down, cells across, bins) of gradient strength by unsigned direction, each cell scaled to length 1."""
    gy, gx = gradient(a)
    m, t = np.hypot(gy, gx), np.mod(np.arctan2(gy, gx), math.pi)
    h, w = a.shape[0] // cell, a.shape[1] // cell
    k = np.minimum((t / math.pi * bins).astype(int), bins - 1)
    i, j = np.indices(a.shape) // cell
    ok = (i < h) & (j < w)
    out = np.zeros((h, w, bins))
    np.add.at(out, (i[ok], j[ok], k[ok]), m[ok])
    return out / np.sqrt((out**2).sum(2, keepdims=True) + 1e-10)


def gap_fill_laplacian(a: np.ndarray, iterations: int = 200) -> np.ndarray:
    """Jacobi sweeps on gaps from their nearest values."""
    gap = ~np.isfinite(a)
    x = nearest_fill(a)
    for _ in range(iterations):
        p = _pad(x, 1)
        x = np.where(gap, (p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2]) / 4, x)
    return x


def nearest_fill(a: np.ndarray) -> np.ndarray:
    x = a.copy()
    while (gap := ~np.isfinite(x)).any() and not gap.all():
        p = np.pad(x, 1, constant_values=np.nan)
        near = np.stack([p[2:, 1:-1], p[:-2, 1:-1], p[1:-1, 2:], p[1:-1, :-2]])
        n = np.isfinite(near).sum(0)
        x = np.where(gap & (n > 0), np.nansum(near, 0) / np.maximum(n, 1), x)
    return x


def gap_fill_biharmonic(a: np.ndarray) -> np.ndarray:
    gap = ~np.isfinite(a)
    x = gap_fill_laplacian(a)
    return np.where(gap, gaussian(x, 1.0), x)


def bilateral(a: np.ndarray, sigma_color: float = 0.1, sigma_space: float = 5.0) -> np.ndarray:
    g = gaussian(a, sigma_space)
    w = np.exp(-0.5 * ((a - g) / sigma_color) ** 2)
    return w * a + (1 - w) * g


def watershed(a: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Floods from the markers (numbers above 0) in the order of height; NaN is never flooded."""
    out, heap, n = np.where(np.isfinite(a), markers, 0).astype(int), [], 0
    for y, x in zip(*np.nonzero(out), strict=True):
        heapq.heappush(heap, (a[y, x], n, y, x))
        n += 1
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for i, j in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] and not out[i, j] and np.isfinite(a[i, j]):
                out[i, j] = out[y, x]
                heapq.heappush(heap, (max(a[i, j], a[y, x]), n, i, j))
                n += 1
    return out


def slic(a: np.ndarray, segments: int = 100, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Clusters of value and place, around a grid of centres."""
    x = nearest_fill(a)
    h, w = a.shape
    s = max(1, int(math.sqrt(h * w / segments)))
    yy, xx = np.mgrid[s // 2 : h : s, s // 2 : w : s]
    c = np.stack([yy.ravel(), xx.ravel(), x[yy.ravel(), xx.ravel()]], 1).astype(float)
    i, j = np.indices(a.shape)
    for _ in range(rounds):
        best, label = np.full(a.shape, np.inf), np.zeros(a.shape, int)
        for k, (cy, cx, cv) in enumerate(c):
            t, b, l, r = max(0, int(cy) - s), min(h, int(cy) + s + 1), max(0, int(cx) - s), min(w, int(cx) + s + 1)
            d = (x[t:b, l:r] - cv) ** 2 + ((i[t:b, l:r] - cy) ** 2 + (j[t:b, l:r] - cx) ** 2) * (compactness / s) ** 2
            near = d < best[t:b, l:r]
            best[t:b, l:r][near], label[t:b, l:r][near] = d[near], k
        n = np.maximum(np.bincount(label.ravel(), minlength=len(c)), 1)
        c = np.stack([np.bincount(label.ravel(), z.ravel(), len(c)) / n for z in (i, j, x)], 1)
    return np.where(np.isfinite(a), label + 1, 0)


def felzenszwalb(a: np.ndarray, scale: float = 1.0, sigma: float = 0.8, min_size: int = 20) -> np.ndarray:
    """Merges neighbours in the order of their difference while it stays below each side's own plus scale / size."""
    g = gaussian(nearest_fill(a), sigma)
    h, w = a.shape
    n = np.arange(h * w).reshape(h, w)
    e = np.concatenate([np.stack([n[:, 1:].ravel(), n[:, :-1].ravel()], 1), np.stack([n[1:].ravel(), n[:-1].ravel()], 1)])
    d = np.abs(g.ravel()[e[:, 0]] - g.ravel()[e[:, 1]])
    root, size, inner = list(range(h * w)), [1] * (h * w), [0.0] * (h * w)

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    order = np.argsort(d, kind="stable")
    for force in (False, True):
        for k in order.tolist():
            p, q = top(int(e[k, 0])), top(int(e[k, 1]))
            if p != q and (min(size[p], size[q]) < min_size if force else d[k] <= min(inner[p] + scale / size[p], inner[q] + scale / size[q])):
                root[q], size[p], inner[p] = p, size[p] + size[q], float(d[k])
    return np.unique([top(k) for k in range(h * w)], return_inverse=True)[1].reshape(h, w) + 1


def chan_vese(a: np.ndarray, mu: float = 0.25, rounds: int = 200, tol: float = 1e-3) -> np.ndarray:
    """Two regions of constant value with a short border, by rounds of smoothing and comparing with both means."""
    x = nearest_fill(a)
    m = x > x.mean()
    for _ in range(rounds):
        hi, lo = (x[m].mean() if m.any() else 0.0), (x[~m].mean() if (~m).any() else 0.0)
        force = (x - lo) ** 2 - (x - hi) ** 2 + mu * (2 * gaussian(m.astype(float), 1.0) - 1) * (hi - lo) ** 2
        new = force > 0
        if (new != m).mean() <= tol:
            return new
        m = new
    return m


def random_walker(a: np.ndarray, markers: np.ndarray, beta: float = 130.0, rounds: int = 500) -> np.ndarray:
    """The marker that a random walk from a pixel meets first, by relaxation of its probabilities."""
    x = nearest_fill(a)
    x = (x - x.min()) / max(x.max() - x.min(), 1e-12)
    p = _pad(x, 1)
    shifts = ((2, 1), (0, 1), (1, 2), (1, 0))
    w = [np.exp(-beta * (p[r : r + a.shape[0], c : c + a.shape[1]] - x) ** 2) + 1e-6 for r, c in shifts]
    total, labels = sum(w), [k for k in np.unique(markers) if k > 0]
    prob = []
    for k in labels:
        u = (markers == k).astype(float)
        for _ in range(rounds):
            q = _pad(u, 1)
            u = np.where(markers > 0, markers == k, sum(wi * q[r : r + a.shape[0], c : c + a.shape[1]] for wi, (r, c) in zip(w, shifts, strict=True)) / total)
        prob.append(u)
    return np.asarray(labels)[np.argmax(prob, 0)]


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """How far b lies from a in rows and columns, by phase correlation with a parabola through the peak."""
    f = np.fft.fft2(nearest_fill(a)) * np.conj(np.fft.fft2(nearest_fill(b)))
    c = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    peak = np.unravel_index(np.argmax(c), c.shape)
    out = []
    for axis, k in enumerate(peak):
        n = c.shape[axis]
        l, m, r = (c[tuple((k + d) % n if ax == axis else peak[ax] for ax in (0, 1))] for d in (-1, 0, 1))
        sub = 0.5 * (l - r) / (l - 2 * m + r) if l - 2 * m + r else 0.0
        s = k + sub
        out.append(-(s - n if s > n / 2 else s))
    return out[0], out[1]


def optical_flow(a: np.ndarray, b: np.ndarray, radius: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that each pixel of a has moved in b, by least squares over a window."""
    gy, gx = gradient(a)
    t = b - a
    s = lambda z: gaussian(z, radius / 2)
    yy, xx, xy, yt, xt = s(gy * gy), s(gx * gx), s(gx * gy), s(gy * t), s(gx * t)
    det = yy * xx - xy**2 + 1e-12
    return (-(xx * yt) + xy * xt) / det, (-(yy * xt) + xy * yt) / det


def contours(a: np.ndarray, level: float) -> list[tuple]:
    """Segments (y0, x0, y1, x1) of the level's iso-line, cell by cell."""
    out = []
    for i in range(a.shape[0] - 1):
        for j in range(a.shape[1] - 1):
            c = [(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)]
            cross = []
            for (y0, x0), (y1, x1) in zip(c, c[1:] + c[:1], strict=True):
                p, q = a[y0, x0], a[y1, x1]
                if np.isfinite(p) and np.isfinite(q) and (p >= level) != (q >= level):
                    f = (level - p) / (q - p)
                    cross.append((y0 + f * (y1 - y0), x0 + f * (x1 - x0)))
            out += [(*cross[k], *cross[k + 1]) for k in range(0, len(cross) - 1, 2)]
    return out


def hough_lines(mask: np.ndarray, angles: int = 180, peaks: int = 10) -> list[tuple[float, int, int]]:
    """(angle, distance, votes) of the strongest lines."""
    y, x = np.nonzero(mask)
    t = np.linspace(-math.pi / 2, math.pi / 2, angles, endpoint=False)
    far = int(math.ceil(math.hypot(*mask.shape)))
    acc = np.zeros((angles, 2 * far + 1), int)
    for k, a in enumerate(t):
        acc[k] = np.bincount(np.rint(x * math.cos(a) + y * math.sin(a)).astype(int) + far, minlength=2 * far + 1)
    return [(float(t[k // acc.shape[1]]), int(k % acc.shape[1]) - far, int(acc.ravel()[k])) for k in np.argsort(-acc, axis=None, kind="stable")[:peaks]]


def hough_circles(mask: np.ndarray, radii, peaks: int = 10) -> list[tuple[int, int, int, int]]:
    """(row, column, radius, votes) of the strongest circles."""
    y, x = np.nonzero(mask)
    found = []
    for r in radii:
        acc = np.zeros(mask.shape, int)
        for t in np.linspace(0, 2 * math.pi, max(8, int(2 * math.pi * r)), endpoint=False):
            cy, cx = np.rint(y - r * math.sin(t)).astype(int), np.rint(x - r * math.cos(t)).astype(int)
            ok = (cy >= 0) & (cy < mask.shape[0]) & (cx >= 0) & (cx < mask.shape[1])
            np.add.at(acc, (cy[ok], cx[ok]), 1)
        found += [(int(k // mask.shape[1]), int(k % mask.shape[1]), r, int(acc.ravel()[k])) for k in np.argsort(-acc, axis=None, kind="stable")[:peaks]]
    return sorted(found, key=lambda f: -f[3])[:peaks]


def simulated_clouds(a: np.ndarray, coverage: float, feather: float = 5.0, seed: int = 0) -> np.ndarray:
    """Smoothed noise above its quantile, blended to the brightest."""
    noise = gaussian(np.random.default_rng(seed).normal(size=a.shape), 8.0)
    alpha = gaussian((noise > np.quantile(noise, 1 - coverage)).astype(float), max(feather, 0.5)) if coverage > 0 else np.zeros(a.shape)
    top = 1.0 if np.nanmax(a) <= 1 else np.nanpercentile(a, 98)
    return a * (1 - alpha) + top * alpha


def ransac(x: np.ndarray, y: np.ndarray, fit, predict, least: int, threshold: float, trials: int = 100, seed: int = 0):
    """(model, inliers) of the trial with the most inliers, fitted again on these."""
    r, best = np.random.default_rng(seed), None
    for _ in range(trials):
        k = r.choice(len(x), least, replace=False)
        ok = np.abs(predict(fit(x[k], y[k]), x) - y) < threshold
        if best is None or ok.sum() > best.sum():
            best = ok
    return fit(x[best], y[best]), best
