"""From points to templates: density peaks with chosen centres, smoothing, alignment, amplitude bounds, global merges and mixtures."""

from __future__ import annotations

import numpy as np


def robust_line(x: np.ndarray, y: np.ndarray, rounds: int = 50, bend: float = 1.345) -> np.ndarray:
    """The fitted values of a line by Huber's weights, the scale from the median absolute residual."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x))
    beta = np.zeros(2)
    for _ in range(rounds):
        last = beta
        beta = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        rest = y - a @ beta
        scale = np.median(np.abs(rest)) / 0.6745
        if scale <= 0 or np.allclose(beta, last, rtol=1e-8, atol=1e-12):
            break
        w = np.minimum(1, bend * scale / np.maximum(np.abs(rest), 1e-300))
    return a @ beta


def centres(rho: np.ndarray, delta: np.ndarray, alpha: float = 3.0) -> np.ndarray:
    """Points whose delta stands out from the line of delta on rho by ``alpha`` deviations times one more than the line."""
    if not len(rho) or rho.min() == rho.max():
        return np.zeros(0, int)
    fitted = robust_line(rho, delta)
    off = delta - fitted
    spread = np.median(np.abs(off - np.median(off)))
    return np.flatnonzero(off >= alpha * spread * (1 + fitted))


def density_peaks(x: np.ndarray, share: float = 0.01, alpha: float = 3.0, halo: float = 3.0, least: int = 10, most: float = 0.02) -> np.ndarray:
    """Labels 0, 1, ... of points (n, d), -1 for those in no cluster.

    A point's density falls with the mean distance to its ``share`` nearest, five at least. Centres are chosen from density and the
    distance to the nearest denser point; the others follow that point. Points of a cluster far below its median density go, unless
    too few would stay; clusters under ``least`` points go. While more than ``most`` of all points would be centres, ``alpha`` grows.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    power = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(power[:, None] + power - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    k = min(max(5, int(share * n)), n - 1)
    mean = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1).mean(axis=1)
    rho = mean.max() - mean
    order = np.lexsort((np.arange(n), -rho))
    delta, parent = np.zeros(n), np.full(n, -1)
    for r, i in enumerate(order[1:], 1):
        j = order[:r][d[i, order[:r]].argmin()]
        delta[i], parent[i] = d[i, j], j
    delta[order[0]] = delta.max()
    chosen = centres(rho, delta, alpha)
    labels = np.full(n, -1)
    while len(chosen) > max(1, most * n):
        alpha *= 1.5
        chosen = centres(rho, delta, alpha)
    if not len(chosen):
        return labels
    labels[chosen] = np.arange(len(chosen))
    if len(chosen) == 1:
        labels[:] = 0
    for i in order:
        if labels[i] < 0 and parent[i] >= 0:
            labels[i] = labels[parent[i]]
    found = labels.copy()
    for c in range(len(chosen)):
        own = np.flatnonzero(labels == c)
        if not len(own):
            continue
        middle = np.median(rho[own])
        out = own[rho[own] < middle - halo * np.median(np.abs(rho[own] - middle))]
        if len(own) - len(out) > least:
            found[out] = -1
        if len(own) < least:
            found[own] = -1
    kept = np.unique(found[found >= 0])
    return np.where(found >= 0, np.searchsorted(kept, found), -1)


def savitzky_golay(x: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Along the last axis: each value from the polynomial fitted to the ``window`` around it, at the ends to the first and last window."""
    half, n = window // 2, x.shape[-1]
    if n < window:
        return x.copy()
    powers = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    hat = powers @ np.linalg.pinv(powers)
    around = np.lib.stride_tricks.sliding_window_view(x, window, axis=-1)
    out = np.empty(x.shape)
    out[..., half : n - half] = around @ hat[half]
    out[..., :half] = around[..., 0, :] @ hat[:half].T
    out[..., n - half :] = around[..., -1, :] @ hat[half + 1 :].T
    return out


def smooth(template: np.ndarray, fast: int, slow: int, degree: int = 3, width: float = 0.25) -> np.ndarray:
    """A template (channel, time) by a fast window about its middle and a slow one away from it."""
    n = template.shape[-1]
    at = (np.arange(n) - n // 2) / max(1.0, width * n)
    near = np.exp(-at * at / 2)
    return near * savitzky_golay(template, fast, degree) + (1 - near) * savitzky_golay(template, slow, degree)


def shifted(template: np.ndarray, lag: int) -> np.ndarray:
    """Moved by ``lag`` steps along the last axis, zeros where nothing is known."""
    out = np.zeros_like(template)
    n = template.shape[-1]
    if abs(lag) < n:
        out[..., max(0, lag) : n + min(0, lag)] = template[..., max(0, -lag) : n - max(0, lag)]
    return out


def centred(template: np.ndarray, sign: int = -1) -> np.ndarray:
    """Shifted so that the extremum over all channels is in the middle."""
    v = template * sign if sign else np.abs(template)
    return shifted(template, template.shape[-1] // 2 - int(np.unravel_index(v.argmax(), v.shape)[-1]))


def align(waves: np.ndarray, sign: int = -1, fine: int = 10, jitter: int = 2) -> np.ndarray:
    """Waveforms (n, time) moved by fractions of a step so that their extrema, looked for within ``jitter`` steps of the middle, meet there.

    Between steps a cubic through the four nearest is taken; the ends are repeated.
    """
    n, t = waves.shape
    padded = np.pad(waves, ((0, 0), (2 + jitter, 3 + jitter)), mode="edge")

    def at(x: np.ndarray) -> np.ndarray:
        i = np.floor(x).astype(int)
        f = x - i
        a, b, c, d = (np.take_along_axis(padded, i + k + 1 + jitter, axis=1) for k in range(4))
        return b + f * ((c - a) / 2 + f * (a - 2.5 * b + 2 * c - d / 2 + f * ((d - a) / 2 + 1.5 * (b - c))))

    grid = t // 2 + np.arange(-jitter * fine, jitter * fine + 1) / fine
    seen = at(np.repeat(grid[None], n, axis=0))
    seen = seen * sign if sign else np.abs(seen)
    best = grid[seen.argmax(axis=1)] - t // 2
    return at(np.clip(np.arange(t)[None] + best[:, None], -1.0 - jitter, t + jitter - 0.0))


def error(good: np.ndarray, bad: np.ndarray, low: float, high: float) -> float:
    """One minus the correlation of being good with lying in [low, high]; 1 where there is none."""
    tp = int(((good >= low) & (good <= high)).sum())
    fp = int(((bad >= low) & (bad <= high)).sum())
    fn, tn = len(good) - tp, len(bad) - fp
    norm = float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return 1 - (tp * tn - fp * fn) / np.sqrt(norm) if norm > 0 else 1.0


def amplitude_bounds(good: np.ndarray, bad: np.ndarray, most: float | None = None, alpha: float = 1e-2) -> tuple[float, float, float]:
    """(low, high, purity): bounds in [0, 1] and [1, most] with the least error and a penalty on their narrowness.

    Between two values the error does not change and the penalty falls towards the wider one, so the best bounds lie at values or at
    the ends, and all of these are tried. Too few good values give bounds about what there is.
    """
    most = (1.25 * good.max() if len(good) else 3.0) if most is None else most
    most = 3.0 if most <= 1 else most
    if not len(good):
        return 0.5, 1.5, 0.0
    if len(good) < 0.1 * (len(good) + len(bad)):
        low, high = 0.75 * good.min(), 1.25 * good.max()
        return float(low), float(high), float(min(1, 1 - error(good, bad, low, high)))
    both = np.unique(np.concatenate([good, bad]))
    # a bound just beyond a bad value leaves it out and is the widest to do so
    lows = np.unique(np.r_[0.0, np.nextafter(both[(both >= 0) & (both < 1)], np.inf)])
    highs = np.unique(np.r_[most, np.nextafter(both[(both > 1) & (both <= most)], -np.inf)])
    count = lambda v: np.maximum(np.searchsorted(np.sort(v), highs, "right")[None, :] - np.searchsorted(np.sort(v), lows, "left")[:, None], 0).astype(float)
    tp, fp = count(good), count(bad)
    fn, tn = len(good) - tp, len(bad) - fp
    norm = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.where(norm > 0, 1 - (tp * tn - fp * fn) / np.sqrt(norm), 1.0)
    cost = cost + alpha * (most - (highs[None, :] - lows[:, None])) ** 2
    i, j = np.unravel_index(cost.argmin(), cost.shape)
    return float(lows[i]), float(highs[j]), float(min(1, 1 - error(good, bad, lows[i], highs[j])))


def similarity(templates: np.ndarray) -> np.ndarray:
    """The largest normalised overlap of each two templates (n, channel, time) over all lags; 0 of one with itself."""
    n, _, t = templates.shape
    size = 1 << (2 * t - 1).bit_length()
    f = np.fft.rfft(templates, size, axis=2)
    norm = np.sqrt((templates**2).sum(axis=(1, 2)))
    out = np.zeros((n, n))
    for i in range(n):
        lags = np.fft.irfft((f[i][None].conj() * f).sum(axis=1), size, axis=1)
        out[i] = np.concatenate([lags[:, :t], lags[:, size - t + 1 :]], axis=1).max(axis=1) / np.maximum(norm[i] * norm, 1e-300)
    np.fill_diagonal(out, 0)
    return out


def merge_similar(similar: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """For each template the one that it becomes: the two most similar are merged while they reach the threshold, into the one with more
    points and of equal ones the second."""
    s, sizes, into, open_ = similar.copy(), sizes.astype(float).copy(), np.arange(len(sizes)), np.ones(len(sizes), bool)
    while open_.sum() > 1:
        masked = np.where(open_[:, None] & open_[None], s, -np.inf)
        i, j = np.unravel_index(masked.argmax(), masked.shape)
        if masked[i, j] < threshold:
            break
        keep, gone = (i, j) if sizes[i] > sizes[j] else (j, i)
        into[into == gone] = keep
        sizes[keep] += sizes[gone]
        open_[gone] = False
    return into


def mixtures(templates: np.ndarray, bounds: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each template (n, channel, time) is a sum of two or more others, as spikes that often overlap leave one.

    Others are subtracted greedily, within a third of a template of its middle and each with an amplitude within its ``bounds``; what
    they add up to must correlate with the template beyond the square of the threshold. Templates found to be mixtures explain no others.
    """
    n, c, t = templates.shape
    mixed, reach = np.zeros(n, bool), max(1, t // 6)
    power = (templates**2).sum(axis=(1, 2))
    for k in np.argsort(-power, kind="stable"):
        rest, built, parts, used = templates[k].astype(float).copy(), np.zeros((c, t)), 0, set()
        while True:
            best = None
            for j in range(n):
                if j == k or mixed[j] or j in used:
                    continue
                for lag in range(-reach, reach + 1):
                    w = shifted(templates[j], lag)
                    a = float((rest * w).sum() / max(power[j], 1e-300))
                    if bounds[j, 0] < a < bounds[j, 1] and (best is None or a * np.sqrt(power[j]) > best[0]):
                        best = (a * np.sqrt(power[j]), j, a, w)
            if best is None:
                break
            _, j, a, w = best
            used.add(j)
            rest, built, parts = rest - a * w, built + a * w, parts + 1
        norm = np.sqrt((built**2).sum() * power[k])
        mixed[k] = parts >= 2 and norm > 0 and (built * templates[k]).sum() / norm > threshold**2
    return mixed
