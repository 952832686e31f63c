"""Whether two groups of points are one: statistics of unimodality and distance, and merging by them."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np

# fixed values: the gamma law of the dip's null distribution, and the folding test's decision bound
DIP_SHAPE, DIP_SCALE = 21.642, 1.84157e-2
BOUND_A, BOUND_B, BOUND_C = 0.4785, 0.1946, 2.0287


def _hull(x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
    """Positions of the corners of the lower (side 1) or upper (-1) convex hull of points in order of x."""
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            turn = (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a])
            if side * turn > 0:
                break
            kept.pop()
        kept.append(i)
    return np.array(kept)


def dip(x: np.ndarray) -> float:
    """Hartigan's dip: the least distance of the distribution function to any unimodal one."""
    x = np.sort(np.asarray(x, np.float64))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 1 / (2 * max(n, 1))
    below, above = np.arange(n) / n, np.arange(1, n + 1) / n
    low, high, best = 0, n - 1, 1 / n
    while high > low:
        part = slice(low, high + 1)
        g, u = low + _hull(x[part], below[part], 1), low + _hull(x[part], above[part], -1)
        at_g = np.interp(x[g], x[u], above[u]) - below[g]
        at_u = above[u] - np.interp(x[u], x[g], below[g])
        if at_g.max() >= at_u.max():
            gap, left = at_g.max(), g[at_g.argmax()]
            right = u[min(np.searchsorted(u, left), len(u) - 1)]
        else:
            gap, right = at_u.max(), u[at_u.argmax()]
            left = g[max(np.searchsorted(g, right, "right") - 1, 0)]
        if gap <= best:
            break
        convex = above[low : left + 1] - np.interp(x[low : left + 1], x[g], below[g])
        concave = np.interp(x[right : high + 1], x[u], above[u]) - below[right : high + 1]
        best = max(best, convex.max(), concave.max())
        if left <= low and right >= high:
            break
        low, high = max(left, low), min(right, high)
    return best / 2


def dip_threshold(n: int, p: float) -> float:
    """The dip that n uniform points exceed with probability p: a gamma quantile, by Wilson and Hilferty."""
    k = DIP_SHAPE
    z = NormalDist().inv_cdf(1 - p)
    return k * DIP_SCALE / np.sqrt(n) * (1 - 1 / (9 * k) + z * np.sqrt(1 / (9 * k))) ** 3


def folding(x: np.ndarray, markov: bool = True) -> tuple[bool, float, float]:
    """(unimodal, p, statistic) of the folding test on points (n, d): whether distances to the best pivot vary less than uniform ones would.

    With ``markov`` a unimodal outcome is withdrawn where the mean distance to the pivot is too large for the points' extent.
    """
    x = np.asarray(x, np.float64)
    x = x[:, None] if x.ndim == 1 else x
    n, d = x.shape
    covariance = np.cov(x, rowvar=False).reshape(d, d)
    mixed = np.array([np.cov(x[:, k], (x * x).sum(axis=1))[0, 1] for k in range(d)])
    pivot = 0.5 * np.linalg.lstsq(covariance, mixed, rcond=None)[0]
    far = np.sqrt(((x - pivot) ** 2).sum(axis=1))
    statistic = (1 + d) ** 2 * far.var(ddof=1) / np.trace(covariance)
    unimodal = bool(statistic >= 1)
    if unimodal and markov:
        extent = np.sqrt(((x.max(axis=0) - x.min(axis=0)) ** 2).sum())
        unimodal = bool((far / extent).mean() <= np.sqrt(d) / (2 * (d + 1)))
    off = abs(statistic - 1) * np.sqrt(n) / (BOUND_A * (BOUND_C + np.log(d)))
    low, high = 0.0, 1.0  # q - b * log(1 - q) grows with q
    for _ in range(200):
        q = (low + high) / 2
        if q < 1 and q - BOUND_B * np.log(1 - q) < off:
            low = q
        else:
            high = q
    return unimodal, 1 - low, float(statistic)


def gaussian_bhattacharyya(a: np.ndarray, b: np.ndarray) -> float:
    """Of two groups (n, d) taken as normal; infinite where one has no volume."""
    ca, cb = (np.cov(v, rowvar=False).reshape(v.shape[1], -1) for v in (a, b))
    both, off = (ca + cb) / 2, a.mean(axis=0) - b.mean(axis=0)
    dets = np.linalg.det(ca) * np.linalg.det(cb)
    if not dets > 0:
        return np.inf
    return float(off @ np.linalg.solve(both, off) / 8 + np.log(np.linalg.det(both) / np.sqrt(dets)) / 2)


def kernel_density(x: np.ndarray, at: np.ndarray, factor: float = 0.1) -> np.ndarray:
    """Normal kernels of ``factor`` standard deviations."""
    width = factor * x.std(ddof=1)
    z = (at[:, None] - x[None]) / width
    return np.exp(-z * z / 2).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi))


def bhattacharyya(a: np.ndarray, b: np.ndarray, method: str = "continuous", steps: int = 50, bounds: tuple[float, float] | None = None) -> float:
    """Of two samples of one feature, by kernel densities ("continuous"), ten bins ("hist"), Doane's bins ("autohist") or equal values ("noiseless")."""
    both = np.concatenate([a, b])
    low, high = bounds if bounds is not None and method == "continuous" else (both.min(), both.max())
    if method == "continuous":
        at = np.linspace(low, high, steps)
        overlap = np.sqrt(kernel_density(a, at) * kernel_density(b, at)).sum() * (high - low) / steps
    elif method in ("hist", "autohist"):
        edges = np.linspace(low, high, 11) if method == "hist" else np.histogram_bin_edges(both, "doane")
        pa, pb = (np.histogram(v, edges)[0] / len(v) for v in (a, b))
        overlap = np.sqrt(pa * pb).sum()
    elif method == "noiseless":
        values = np.unique(both)
        pa, pb = ((v[:, None] == values[None]).mean(axis=0) for v in (a, b))
        overlap = np.sqrt(pa * pb).sum()
    else:
        raise ValueError(f"no such method: {method}")
    return float(-np.log(overlap)) if overlap > 0 else np.inf


def _line(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both groups on the line between their medians."""
    axis = np.median(a, axis=0) - np.median(b, axis=0)
    return a @ axis, b @ axis


def _by_distance(a, b, _):
    a, b = _line(a, b)
    ma, mb = np.median(a), np.median(b)
    spread = np.median(np.abs(a - ma)) ** 2 + np.median(np.abs(b - mb)) ** 2
    return abs(ma - mb) / np.sqrt(spread) if spread > 0 else np.inf


def _by_dip(a, b, p):
    x = np.concatenate(_line(a, b))
    return dip(x) / dip_threshold(len(x), p) if len(x) > 5 else np.inf


def _by_folding(a, b, _):
    unimodal, p, _ = folding(np.concatenate(_line(a, b)))
    return p if unimodal else np.inf


def _by_nd_folding(a, b, _):
    unimodal, p, _ = folding(np.concatenate([a, b])[:, :3])
    return p if unimodal else np.inf


#: name: the statistic of two groups, and the threshold under which they are one as a function of the parameter.
METRICS: dict[str, tuple[Callable, Callable[[float], float], float]] = {
    "distance": (_by_distance, lambda p: p / 0.674, 3.0),
    "dip": (_by_dip, lambda p: 1.0, 0.5),
    "folding": (_by_folding, lambda p: p, 1e-9),
    "nd-folding": (_by_nd_folding, lambda p: p, 1e-9),
    "bhatta": (lambda a, b, _: bhattacharyya(*_line(a, b)), lambda p: p, 2.0),
    "nd-bhatta": (lambda a, b, _: gaussian_bhattacharyya(a, b), lambda p: p, 2.0),
}


def merge(x: np.ndarray, labels: np.ndarray, method: str = "nd-bhatta", parameter: float | None = None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(labels, history): the nearest two groups become one, under the smaller label, while they are nearer than the method's threshold.

    Labels below zero take no part; a statistic that cannot be had counts as infinite; ties go to the pair of smaller labels. Statistics
    are kept from round to round, so a merge costs one row of pairs.
    """
    statistic, limit, default = METRICS[method]
    parameter = default if parameter is None else parameter
    labels = labels.copy()
    known: dict[tuple[int, int], float] = {}
    history = []

    def between(i: int, j: int) -> float:
        if (i, j) not in known:
            try:
                with np.errstate(all="ignore"):
                    d = float(statistic(x[labels == i], x[labels == j], parameter))
            except (ValueError, np.linalg.LinAlgError):
                d = np.inf
            known[i, j] = np.inf if np.isnan(d) else d
        return known[i, j]

    while True:
        names = [int(v) for v in np.unique(labels) if v >= 0]
        pairs = [(between(i, j), i, j) for k, i in enumerate(names) for j in names[k + 1 :]]
        if not pairs or (best := min(pairs))[0] >= limit(parameter):
            return labels, history
        d, i, j = best
        labels[labels == j] = i
        history.append((i, j, d))
        known = {p: v for p, v in known.items() if not {i, j} & set(p)}
