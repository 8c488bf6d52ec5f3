"""NumPy kernels on gray pages (uint8 arrays, 0 black to 255 white).

Windows are rectangular with odd sides and are cut off at the page's edge.
"""

from __future__ import annotations

import numpy as np


def _slide(a: np.ndarray, k: int, axis: int, f, fill) -> np.ndarray:
    """f over a centred window of k along the axis, by doubling strides."""
    half = k // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (half, half)
    p = np.pad(a, pad, constant_values=fill)
    take = lambda x, start, n: np.take(x, range(start, start + n), axis)
    size, reach = p, 1
    while reach * 2 <= k:
        n = size.shape[axis] - reach
        size = f(take(size, 0, n), take(size, reach, n))
        reach *= 2
    n = a.shape[axis]
    return f(take(size, 0, n), take(size, k - reach, n))


def dilate(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return _slide(_slide(a, kx, 1, np.maximum, a.dtype.type(0)), ky, 0, np.maximum, a.dtype.type(0)) if a.size else a


def erode(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    top = np.iinfo(a.dtype).max if a.dtype != bool else True
    return _slide(_slide(a, kx, 1, np.minimum, top), ky, 0, np.minimum, top) if a.size else a


def opened(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return dilate(erode(a, kx, ky), kx, ky)


def closed(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return erode(dilate(a, kx, ky), kx, ky)


def box_sum(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    """Sums over windows, by prefix sums."""
    if not a.size:
        return a.astype(np.int64)
    out = a.astype(np.int64)
    for axis, k in ((1, kx), (0, ky)):
        n, half = out.shape[axis], k // 2
        c = np.cumsum(out, axis)
        c = np.concatenate([np.zeros_like(np.take(c, [0], axis)), c], axis)
        hi, lo = np.minimum(np.arange(n) + half + 1, n), np.maximum(np.arange(n) - half, 0)
        out = np.take(c, hi, axis) - np.take(c, lo, axis)
    return out


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of the 8-connected parts of a mask, and their number.

    Rows are cut into runs.  Runs of neighbouring rows that touch are found by
    binary search, and united in rounds in which every run takes the least number
    known at either end of an edge and numbers are followed to their ends.
    """
    labels = np.zeros(mask.shape, np.int32)
    if not mask.any():
        return labels, 0
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    wide = w + 2
    low = np.searchsorted(y * wide + stop, (y - 1) * wide + start)  # first run above that ends at or behind the start
    high = np.searchsorted(y * wide + start, (y - 1) * wide + stop, "right")
    n = np.maximum(high - low, 0)
    below = np.repeat(np.arange(y.size), n)
    above = np.arange(below.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(y.size)
    while True:
        a, b = root[above], root[below]
        least = np.minimum(a, b)
        if (a == b).all():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while (root != root[root]).any():
            root = root[root]
    names, number = np.unique(root, return_inverse=True)
    flat = np.zeros(h * (w + 1), np.int32)
    np.add.at(flat, y * (w + 1) + start, number + 1)
    np.add.at(flat, y * (w + 1) + stop, -(number + 1))
    return np.cumsum(flat.reshape(h, w + 1), axis=1)[:, :w].astype(np.int32), names.size


def component_stats(labels: np.ndarray, n: int) -> np.ndarray:
    """Rows of area, min x, min y, max x, max y of the components 1 to n."""
    y, x = np.nonzero(labels)
    at = labels[y, x] - 1
    out = np.empty((n, 5), np.int64)
    out[:, 0] = np.bincount(at, minlength=n)
    for k, (f, v, fill) in enumerate(((np.minimum, x, 1 << 40), (np.minimum, y, 1 << 40), (np.maximum, x, -1), (np.maximum, y, -1)), 1):
        out[:, k] = fill
        f.at(out[:, k], at, v)
    return out


def shade_flattened(a: np.ndarray, k: int = 15, target: int = 252, inside: np.ndarray | None = None) -> np.ndarray:
    """Brightness divided by the local mean of the paper, the mean of a k-window's closed image.

    inside: the rows that belong to a page (all, where it is null).
    """
    if not a.size:
        return a
    inside = np.ones(a.shape[0], bool) if inside is None else inside
    held = lambda x, fill: np.where(inside[:, None], x, np.asarray(fill, x.dtype))
    paper = held(erode(held(dilate(held(a, 0), 3, 3), 255), 3, 3), 0)
    mean = box_sum(paper, k, k) / np.maximum(box_sum(held(np.ones_like(a), 0), k, k), 1)
    return np.clip(np.rint(a * (target / np.maximum(mean, 1))), 0, 255).astype(np.uint8)


def specks(mask: np.ndarray, most: int = 2, reach: int = 5) -> np.ndarray:
    """The mask's components of at most ``most`` pixels with no other ink in a window of ``reach`` around them."""
    labels, n = components(mask)
    if not n:
        return np.zeros_like(mask)
    area = np.bincount(labels.ravel(), minlength=n + 1)
    near = box_sum(mask, reach, reach)
    own = area[labels]
    small = mask & (own <= most) & (near <= own)
    bad = np.bincount(labels[mask & ~small], minlength=n + 1) > 0
    return small & ~bad[labels]


def bilinear(a: np.ndarray, matrix: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The page seen through the inverse of a 3 x 3 matrix, white outside."""
    h, w = shape
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    m = np.linalg.inv(matrix)
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    sx, sy = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    p = np.pad(a.astype(np.float64), 1, constant_values=255)

    def at(yy, xx):
        return p[np.clip(yy + 1, 0, p.shape[0] - 1), np.clip(xx + 1, 0, p.shape[1] - 1)]

    v = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(v).astype(np.uint8)


def _equations(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The linear equations (..., 2 n, 9) that a mapping of n points fulfils."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    first = np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], axis=-1)
    second = np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], axis=-1)
    return np.concatenate([first, second], axis=-2)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix that brings points src to dst by least squares; null for fewer than four points."""
    if len(src) < 4:
        return None
    m = np.linalg.svd(_equations(np.asarray(src, float), np.asarray(dst, float)))[2][-1].reshape(3, 3)
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def ransac(src: np.ndarray, dst: np.ndarray, tolerance: float = 4.0, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray | None, np.ndarray]:
    """A homography and its inliers from matches with outliers; all rounds are solved at once."""
    n = len(src)
    if n < 4:
        return None, np.zeros(n, bool)
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    pick = np.argsort(np.random.default_rng(seed).random((rounds, n)), axis=1)[:, :4]
    maps = np.linalg.svd(_equations(src[pick], dst[pick]))[2][:, -1].reshape(-1, 3, 3)
    seen = np.c_[src, np.ones(n)] @ maps.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        fits = np.linalg.norm(seen[..., :2] / seen[..., 2:] - dst, axis=-1) <= tolerance
    best = fits[fits.sum(axis=1).argmax()]
    return homography(src[best], dst[best]), best
