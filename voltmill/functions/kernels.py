"""Numpy kernels on (time, channel) arrays; each works on a chunk with a halo on both sides."""

from __future__ import annotations

import numpy as np


def butter(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a Butterworth band-pass, by the bilinear transform of its analogue poles."""
    w = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = w[1] - w[0], w[0] * w[1]
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre)
    poles = np.concatenate([half + root, half - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    upper = z[z.imag > 1e-12]
    upper = upper[np.argsort(np.abs(upper.imag))]
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    at = np.exp(2j * np.arctan(np.sqrt(centre) / (2 * rate)))
    gain = np.prod([np.polyval(s[:3], at) / np.polyval(s[3:], at) for s in sections])
    sections[0, :3] /= abs(gain)
    return sections


def filtfilt(x: np.ndarray, sections: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Zero-phase filtering, as forward and backward runs give it: the squared gain, by Fourier transform over time.

    Both ends are continued by ``pad`` samples turned about the end sample, so a recording's first and last samples ring little;
    beyond that zeros follow. 24 samples for each section where it is not given.
    """
    x = np.asarray(x, np.float64)
    pad = min(len(x) - 1, 24 * len(sections) if pad is None else pad) if len(x) else 0
    if pad > 0:
        x = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    n = 1 << max(1, 2 * len(x) - 1).bit_length()
    z = np.exp(2j * np.pi * np.arange(n // 2 + 1) / n)
    gain = np.prod([np.abs(np.polyval(s[:3], z) / np.polyval(s[3:], z)) ** 2 for s in sections], axis=0)
    return np.fft.irfft(np.fft.rfft(x, n, axis=0) * gain.reshape(-1, *[1] * (x.ndim - 1)), n, axis=0)[pad : len(x) - pad]


def find_peaks(x: np.ndarray, height: float, distance: int = 1) -> np.ndarray:
    """Positions of local maxima of at least ``height``; of two nearer than ``distance`` the larger stays, ties to the later. A plateau counts at its middle."""
    edge = np.flatnonzero(np.diff(x) != 0)
    start, stop = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    inner = np.arange(1, len(start) - 1)
    up = inner[(x[start[inner]] > x[start[inner] - 1]) & (x[start[inner]] > x[stop[inner] + 1])] if len(inner) else inner
    at = (start[up] + stop[up]) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            keep[low[i] : high[i]] = False
            keep[i] = True
    return at[keep]


def whitening(covariance: np.ndarray, floor: float = 1e-18) -> np.ndarray:
    """The symmetric inverse square root."""
    w, v = np.linalg.eigh(covariance)
    return (v / np.sqrt(w + floor)) @ v.T


def pca(x: np.ndarray, components: int) -> np.ndarray:
    """Rows: the leading directions of centred rows, the sign such that the largest entry is positive."""
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    v = v[:components]
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def directions(covariance: np.ndarray, components: int) -> np.ndarray:
    """Rows: the leading eigenvectors, the sign such that the largest entry is positive."""
    _, v = np.linalg.eigh(covariance)
    v = v[:, ::-1][:, :components].T
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def density_clusters(x: np.ndarray, k: int, clusters: int) -> np.ndarray:
    """Labels by density peaks: centres have many near neighbours and no denser point nearby; the rest follow their nearest denser point."""
    power = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(power[:, None] + power - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    rho = np.sort(d, axis=1)[:, 1 : k + 1].mean(axis=1)
    order = np.lexsort((np.arange(len(x)), rho))
    delta, parent = np.full(len(x), d.max()), np.full(len(x), -1)
    for r, i in enumerate(order[1:], 1):
        j = order[:r][d[i, order[:r]].argmin()]
        delta[i], parent[i] = d[i, j], j
    centre = np.argsort(-delta / np.maximum(rho, 1e-12), kind="stable")[:clusters]
    label = np.full(len(x), -1)
    label[centre] = np.arange(len(centre))
    for i in order:
        if label[i] < 0:
            label[i] = label[parent[i]]
    return label


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(i, j, lag): dot products of templates (n, time, channel) of a and b, the latter moved by -(t - 1) to t - 1 steps."""
    t = a.shape[1]
    size = 1 << (2 * t - 1).bit_length()
    fa, fb = np.fft.rfft(a, size, axis=1), np.fft.rfft(b, size, axis=1)
    both = np.fft.irfft(np.einsum("itc,jtc->ijt", fa, fb.conj()), size, axis=2)
    return np.concatenate([both[:, :, size - t + 1 :], both[:, :, :t]], axis=2)


def match(x: np.ndarray, templates: np.ndarray, bounds: np.ndarray, second: np.ndarray | None = None, least_second: float = 0.0, places: np.ndarray | None = None) -> np.ndarray:
    """Rows (template, start, amplitude, second amplitude) found by subtracting the best fit until none lies strictly within its
    template's ``bounds`` (n, 2); a template is taken once at a place, so it ends.

    x: (time, channel); templates, second: (n, time, channel); the second component is subtracted where its amplitude exceeds
    ``least_second``. ``places``: the starts that are looked at, all where not given; others are neither taken nor changed.
    """
    n, t = templates.shape[:2]
    starts = np.arange(len(x) - t + 1) if places is None else np.asarray(places, np.int64)
    starts = starts[(starts >= 0) & (starts <= len(x) - t)]
    if not len(starts) or not n:
        return np.zeros((0, 4))
    every = templates if second is None else np.concatenate([templates, second])
    power = (every.astype(np.float64) ** 2).sum(axis=(1, 2))
    safe = np.maximum(power, 1e-300)
    score = np.empty((len(every), len(starts)))
    for a in range(0, len(starts), 512):
        around = starts[a : a + 512, None] + np.arange(t)
        score[:, a : a + 512] = np.einsum("ntc,ptc->np", every, x[around].astype(np.float64))
    score /= safe[:, None]
    gram, root = _overlaps(every, every), np.sqrt(power[:n])[:, None]
    open_, out = power[:n, None] > np.zeros(len(starts)), []
    low, high = (np.broadcast_to(b[:, None], open_.shape) for b in np.asarray(bounds, np.float64).T)
    while True:
        gain = np.where(open_ & (score[:n] > low) & (score[:n] < high), score[:n] * root, -np.inf)
        i, at = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, at] == -np.inf:
            break
        a = score[i, at]
        b = score[n + i, at] if second is not None else 0.0
        b = b if abs(b) > least_second else 0.0
        out.append((i, starts[at], a, b))
        open_[i, at] = False
        lag = starts[at] - starts
        near = np.abs(lag) < t
        score[:, near] -= a * gram[:, i, t - 1 + lag[near]] / safe[:, None]
        if b:
            score[:, near] -= b * gram[:, n + i, t - 1 + lag[near]] / safe[:, None]
    return np.array(out, np.float64).reshape(-1, 4)


def greedy_match(x: np.ndarray, templates: np.ndarray, low: float, high: float) -> list[tuple[int, int, float]]:
    """``match`` with the same bounds for all templates and no second components: (template, start, amplitude)."""
    found = match(np.asarray(x, np.float64), templates, np.tile([low, high], (len(templates), 1)))
    return [(int(k), int(at), float(a)) for k, at, a, _ in found]
