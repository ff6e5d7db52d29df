"""Brute force on whole frames with NumPy, which the pixel operators are held against."""

from __future__ import annotations

import math

import numpy as np
from rasterweave.operators.stencil import ONE, bilateral_tables, gaussian_weights
from rasterweave.plans.model import MIN_AREA, Settings


def moved(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a at (y + dy, x + dx), edges repeated."""
    h, w = a.shape
    return a[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


def separable(a: np.ndarray, weights: list[int]) -> np.ndarray:
    r, a = len(weights) // 2, a.astype(np.int64)
    a = sum(w * moved(a, 0, k - r) for k, w in enumerate(weights))
    a = sum(w * moved(a, k - r, 0) for k, w in enumerate(weights))
    total = sum(weights) ** 2
    return (2 * a + total) // (2 * total)


def gaussian(a, radius, sigma):
    return separable(a, gaussian_weights(radius, sigma))


def median(a):
    return np.sort(np.stack([moved(a, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), 0)[4]


def bilateral(a, diameter, sigma):
    place, differ = bilateral_tables(diameter, sigma)
    differ, r = np.array(differ, np.int64), diameter // 2
    a = a.astype(np.int64)
    value, weight = np.zeros_like(a), np.zeros_like(a)
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    for s, (dy, dx) in zip(place, offsets):
        n = moved(a, dy, dx)
        w = s * differ[np.abs(n - a)] // ONE
        value += n * w
        weight += w
    return (2 * value + weight) // (2 * weight)


def bilateral_rgb(planes, diameter, sigma):
    """(h, w, 3) planes weighted by the sum of their differences."""
    place, differ = bilateral_tables(diameter, sigma, 3)
    differ, r = np.array(differ, np.int64), diameter // 2
    planes = planes.astype(np.int64)
    value, weight = np.zeros_like(planes), np.zeros(planes.shape[:2], np.int64)
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    for s, (dy, dx) in zip(place, offsets):
        n = np.stack([moved(planes[..., k], dy, dx) for k in range(3)], 2)
        w = s * differ[np.abs(n - planes).sum(2)] // ONE
        value += n * w[..., None]
        weight += w
    return (2 * value + weight[..., None]) // (2 * weight[..., None])


def luma(planes):
    return (299 * planes[..., 0] + 587 * planes[..., 1] + 114 * planes[..., 2] + 500) // 1000


def sobel(a):
    a = a.astype(np.int64)
    d = moved(a, 0, 1) - moved(a, 0, -1)
    s = moved(a, 0, -1) + 2 * a + moved(a, 0, 1)
    return moved(d, -1, 0) + 2 * d + moved(d, 1, 0), moved(s, 1, 0) - moved(s, -1, 0)


def suppress(mag, gx, gy):
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep, falling = ay * 10000 <= ax * 4142, ax * 10000 <= ay * 4142, (gx > 0) == (gy > 0)
    keep = np.zeros(mag.shape, bool)
    for where, (dy, dx) in ((flat, (0, 1)), (steep & ~flat, (1, 0)), (falling & ~flat & ~steep, (1, 1)), (~falling & ~flat & ~steep, (-1, 1))):
        keep |= where & (mag >= moved(mag, dy, dx)) & (mag >= moved(mag, -dy, -dx))
    return np.where(keep, mag, 0)


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components: 1 + the smallest row-major index in each, 0 off."""
    h, w = mask.shape
    big = h * w + 1
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), big)
    while True:
        new = lab
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                new = np.minimum(new, moved(lab, dy, dx))
        new = np.where(mask, new, big)
        flat = np.append(new.ravel(), big)
        for _ in range(3):  # follow labels to their labels
            flat[:-1] = np.minimum(flat[:-1], flat[np.minimum(flat[:-1] - 1, h * w)])
        new = flat[:-1].reshape(h, w)
        if (new == lab).all():
            return np.where(mask, lab, 0)
        lab = new


def hysteresis(strong, weak):
    """Weak pixels connected to a strong one stay."""
    lab = label(strong | weak)
    good = np.unique(lab[strong])
    return np.isin(lab, good[good > 0])


def canny(a, low, high, l2=True):
    gx, gy = sobel(a)
    mag = gx * gx + gy * gy if l2 else np.abs(gx) + np.abs(gy)
    thin = suppress(mag, gx, gy)
    lo, hi = (low * low, high * high) if l2 else (low, high)
    return hysteresis(thin >= hi, thin >= lo).astype(np.int64) * 255


def extreme(m, r, largest):
    pick = np.maximum if largest else np.minimum
    for axis in (0, 1):
        out = m
        for k in range(1, r + 1):
            for s in (-k, k):
                out = pick(out, moved(m, *((s, 0) if axis == 0 else (0, s))))
        m = out
    return m


def close(m, r=1):
    return extreme(extreme(m, r, True), r, False)


def dilate_disc(m, r):
    out = m
    for dy in range(-r, r + 1):
        h = math.isqrt(r * r - dy * dy)
        for dx in range(-h, h + 1):
            out = np.maximum(out, moved(m, dy, dx))
    return out


def clean_speckles(m, intensity):
    lab = label(m > 0)
    area = np.bincount(lab.ravel())
    return np.where((lab > 0) & (area[lab] < MIN_AREA[intensity]), 0, m)


def clahe(a, clip, grid=8):
    h, w = a.shape
    th, tw = -(-h // grid), -(-w // grid)
    maps = np.zeros((grid, grid, 256), np.int64)
    for i in range(grid):
        for j in range(grid):
            tile = a[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
            if not tile.size:
                continue
            hist = np.bincount(tile.ravel(), minlength=256)
            most = max(1, math.floor(tile.size * clip / 256))
            cut = int(np.maximum(0, hist - most).sum())
            level = np.arange(1, 257)
            run = np.cumsum(np.minimum(hist, most)) + level * (cut // 256) + np.minimum(level, cut % 256)
            maps[i, j] = (2 * run * 255 + tile.size) // (2 * tile.size)
    # tiles past the frame's edge take the last real one's map
    used_y, used_x = -(-h // th), -(-w // tw)
    y, x = np.arange(h), np.arange(w)
    gy, gx = (2 * y + 1 - th) // (2 * th), (2 * x + 1 - tw) // (2 * tw)
    wy, wx = 2 * y + 1 - th - 2 * th * gy, 2 * x + 1 - tw - 2 * tw * gx
    s = np.zeros((h, w), np.int64)
    for dy in (0, 1):
        for dx in (0, 1):
            weight = (wy if dy else 2 * th - wy)[:, None] * (wx if dx else 2 * tw - wx)[None]
            s += weight * maps[np.clip(gy + dy, 0, used_y - 1)[:, None], np.clip(gx + dx, 0, used_x - 1)[None], a]
    whole = 4 * tw * th
    return (2 * s + whole) // (2 * whole)


def stretch(a):
    lo, hi = int(a.min()), int(a.max())
    return a if hi == lo else (2 * (a - lo) * 255 + (hi - lo)) // (2 * (hi - lo))


def gamma_table(mean):
    g = min(3.0, max(1.5, 1.0 + (80 - mean) / 40))
    return np.floor(np.power(np.arange(256) / 255, 1 / g) * 255 + 0.5).astype(np.int64)


def line_art(rgb: np.ndarray, s: Settings) -> np.ndarray:
    """(h, w, 3) uint8 in, line art out, stages in their canonical order."""
    planes = rgb.astype(np.int64)
    d, p = s.derived(), s.preset
    raw, smooth = luma(planes), planes
    if s.custom:
        passes = max(1, min(5, s.bilateral_passes)) if s.bilateral else 0
    else:
        passes = 3 if p.passes >= 2 else 1
    for k in range(passes):
        smooth = bilateral_rgb(smooth, p.diameter, d["sigma"] if k == 0 else d["refine"])
    gray = luma(smooth)
    if s.custom and s.gaussian:
        for _ in range(s.gaussian_passes):
            gray = gaussian(gray, 2, 1.1)
    if s.custom and s.median:
        for _ in range(s.median_passes):
            gray = median(gray)
    mean, paint = None, np.arange(256)
    if s.auto_normalize or not s.custom:
        mean, std = raw.mean(), raw.std()
        if mean < 80:
            paint = gamma_table(mean)
            raw, gray = paint[raw], paint[gray]
        if std < 45:
            gray = stretch(gray)
        gray = clahe(gray, max(1.5, min(4.5, 150 / max(mean, 1))))
    gray = gaussian(gray, 2, 1.1)
    if s.custom and s.dark_boost:
        gray = clahe(gray, max(1.0, min(6.0, s.dark_boost_clip or 2.5)))
    edges = close(canny(gray, d["low"], d["high"]))
    if s.custom and s.clean_speckles:
        edges = clean_speckles(edges, s.clean_intensity)
    if s.custom and s.merge_double_edge:
        edges = extreme(close(edges, 1 + max(1, min(5, s.merge_intensity or 2))), 1, False)
    if s.line_weight > 1:
        edges = dilate_disc(edges, s.line_weight - 1)
    out = np.broadcast_to(np.array(p.background), planes.shape).copy()
    if s.custom and s.color_edges:
        source = raw
        if s.color_softness:
            r = s.color_softness
            source = stretch(gaussian(source, r, 0.3 * (r - 1) + 0.8))
            planes = np.stack([gaussian(planes[..., k], r, 0.3 * (r - 1) + 0.8) for k in range(3)], 2)
        lines = canny(source, s.color_low, s.color_high)
        if s.color_line_weight > 1:
            lines = dilate_disc(lines, s.color_line_weight - 1)
        color = paint[planes]
        if s.color_opacity < 1:
            color = np.floor(np.array(p.background) * (1 - s.color_opacity) + color * s.color_opacity).astype(np.int64)
        out = np.where((lines > 127)[..., None], color, out)
    out = np.where((edges > 127)[..., None], np.array(p.ink), out)
    return out.astype(np.uint8)
