"""Per-frame filters on float32 planes with NaN for missing pixels."""

from __future__ import annotations

import numpy as np

_TAPS = {"GAUSSIAN_0_7": [1, 2, 1], "GAUSSIAN_1_0": [1, 4, 6, 4, 1]}


def _smooth(a: np.ndarray, taps: list[int]) -> np.ndarray:
    """Separable, edges replicated, renormalised over the pixels that are there."""
    v, w = np.where(np.isfinite(a), a, 0.0).astype(np.float64), np.isfinite(a).astype(np.float64)
    r = len(taps) // 2
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
        pv, pw, n = np.pad(v, pad, "edge"), np.pad(w, pad, "edge"), a.shape[axis]
        take = lambda p, k: p[k : k + n] if axis == 0 else p[:, k : k + n]  # noqa: E731, B023
        v, w = sum(t * take(pv, k) for k, t in enumerate(taps)), sum(t * take(pw, k) for k, t in enumerate(taps))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(w > 0, v / w, np.nan).astype(np.float32)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, cut at four sigma, edges replicated."""
    r = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    v = a.astype(np.float64)
    for axis in (0, 1):
        p, n = np.pad(v, [(r, r) if i == axis else (0, 0) for i in (0, 1)], "edge"), v.shape[axis]
        v = sum(t * np.take(p, range(k, k + n), axis=axis) for k, t in enumerate(taps))
    return v


def normalised(a: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """A plane between two of its percentiles (nearest rank), from 0 to 1: the common input of compared methods."""
    s = np.sort(a[np.isfinite(a)])
    lo, hi = (float(s[int(np.floor(q / 100 * (len(s) - 1) + 0.5))]) for q in (low, high))
    return np.clip((a - lo) / max(hi - lo, 1e-9), 0, 1).astype(np.float32)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    v = np.pad(np.nan_to_num(a).astype(np.float64), r, "edge")
    c = np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    d = 2 * r + 1
    return (c[d:, d:] - c[:-d, d:] - c[d:, :-d] + c[:-d, :-d]) / d**2


def apply(a: np.ndarray, name: str) -> np.ndarray:
    """A filter by its name; NONE gives the plane back."""
    if name == "NONE":
        return a
    if name in _TAPS:
        return _smooth(a, _TAPS[name])
    if name == "GAUSSIAN_1_4":
        return _smooth(_smooth(a, _TAPS["GAUSSIAN_1_0"]), _TAPS["GAUSSIAN_1_0"])
    if name == "MEDIAN_3X3":
        p = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, "edge"), (3, 3)).reshape(*a.shape, 9)
        return np.nanmedian(p, axis=2).astype(np.float32)
    if name == "ANSCOMBE":
        return (2 * np.sqrt(np.maximum(0, a) + 0.375)).astype(np.float32)
    if name == "ANSCOMBE_GAUSSIAN_1_0":
        return apply(apply(a, "ANSCOMBE"), "GAUSSIAN_1_0")
    if name == "UNSHARP_0_5":
        return np.maximum(0, a + 0.5 * (a - apply(a, "GAUSSIAN_1_0"))).astype(np.float32)
    if name.startswith("LOCAL_CONTRAST_1_"):
        k = int(name.rsplit("_", 1)[1])
        out = a - box_mean(a, max(2, int(min(a.shape) / (2 * k) + 0.5)))
        return (out - np.nanmin(out)).astype(np.float32)
    if name == "STRUCTURAL_GRADIENT":
        s = _smooth(a, _TAPS["GAUSSIAN_0_7"])
        gy, gx = np.gradient(s)
        return np.hypot(gx, gy).astype(np.float32)
    raise ValueError(f"unknown filter {name}")


def area_average(a: np.ndarray, scale: float) -> np.ndarray:
    """Mean over the covered area, 32 x 32 at least."""
    def weights(n: int) -> np.ndarray:
        m = min(n, max(32, int(n * scale + 0.5)))
        edge = np.arange(m + 1) * n / m
        i = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], i + 1) - np.maximum(edge[:-1, None], i), 0, None)

    wy, wx, ok = weights(a.shape[0]), weights(a.shape[1]), np.isfinite(a)
    with np.errstate(invalid="ignore"):
        return ((wy @ np.where(ok, a, 0) @ wx.T) / (wy @ ok @ wx.T)).astype(np.float32)
