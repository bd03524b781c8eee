"""Bitmaps of glyphs as vectors of one size, and their holes."""

from __future__ import annotations

import numpy as np

HEIGHT, WIDTH = 24, 16


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres, edges repeated."""
    out = a.astype(np.float32)
    for axis, size in ((0, height), (1, width)):
        at = np.clip((np.arange(size) + 0.5) * out.shape[axis] / size - 0.5, 0, out.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, out.shape[axis] - 1)
        share = (at - low).astype(np.float32)
        share = share[:, None] if axis == 0 else share[None, :]
        out = np.take(out, low, axis) * (1 - share) + np.take(out, high, axis) * share
    return out


def fitted(a: np.ndarray) -> np.ndarray | None:
    """The ink's box, as large as HEIGHT x WIDTH allows without changing its shape, in the middle; None without ink."""
    ys, xs = np.nonzero(a > 0)
    if not len(xs):
        return None
    box = a[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    scale = min(HEIGHT / box.shape[0], WIDTH / box.shape[1])
    h, w = max(1, int(box.shape[0] * scale)), max(1, int(box.shape[1] * scale))
    out = np.zeros((HEIGHT, WIDTH), np.float32)
    out[(HEIGHT - h) // 2 : (HEIGHT - h) // 2 + h, (WIDTH - w) // 2 : (WIDTH - w) // 2 + w] = resized(box, h, w)
    return out


def scaled(a: np.ndarray) -> np.ndarray:
    """Stretched to HEIGHT x WIDTH, its numbers to 0 to 1; zeros for an empty bitmap."""
    if not a.size:
        return np.zeros((HEIGHT, WIDTH), np.float32)
    r = resized(a, HEIGHT, WIDTH)
    return (r - r.min()) / (r.max() - r.min() + 1e-6)


def holes(a: np.ndarray) -> int:
    """Regions without ink that ink closes in: background joined side by side that doesn't reach the edge. Ink
    is joined at corners too."""
    paper = np.pad(a <= 0, 1, constant_values=True)
    label = np.where(paper, np.arange(1, paper.size + 1).reshape(paper.shape), 0)
    while True:  # the least number of a region spreads over it
        new = label.copy()
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            near = np.roll(label, step, axis)
            new = np.where(paper & (near > 0), np.minimum(new, near), new)
        if (new == label).all():
            return len(np.unique(label[paper])) - 1
        label = new
