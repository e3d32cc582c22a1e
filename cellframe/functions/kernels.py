"""Small NumPy helpers that work on one image inside a task."""

from __future__ import annotations

import numpy as np


def best_match(image: np.ndarray, template: np.ndarray, pad: int) -> tuple[float, int, int]:
    """Best normalised cross-correlation of a template within a padded image of the same size.

    Returns the score and the row and column offset of the best place, from -pad to pad;
    the first place in row order wins ties. A flat patch scores zero.
    """
    padded = np.pad(np.asarray(image, float), pad, mode="reflect")
    t = np.asarray(template, float)
    t = t - t.mean()
    patches = np.lib.stride_tricks.sliding_window_view(padded, t.shape)
    dot = np.einsum("abij,ij->ab", patches, t)
    mean = patches.mean(axis=(2, 3))
    energy = np.einsum("abij,abij->ab", patches, patches) - t.size * mean * mean
    norm = np.sqrt(np.maximum(energy, 0) * (t * t).sum())
    score = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 1e-9)
    at = np.unravel_index(np.argmax(np.round(score, 12)), score.shape)
    return float(score[at]), int(at[0]) - pad, int(at[1]) - pad


def moved(image: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The image moved down by dy and right by dx; uncovered pixels mirror the inside."""
    h, w = image.shape
    p = max(abs(dy), abs(dx))
    padded = np.pad(image, p, mode="reflect") if p else image
    return padded[p - dy:p - dy + h, p - dx:p - dx + w]


#: matrices of the task; there are as many as image sides and scales
_MATRICES: dict[tuple[int, float], np.ndarray] = {}


def blur_matrix(n: int, sigma: float) -> np.ndarray:
    """Gaussian smoothing of n pixels in a row (cut at four sigma, edges repeated) as a matrix."""
    if (n, sigma) in _MATRICES:
        return _MATRICES[n, sigma]
    reach = int(4 * sigma + 0.5)
    offset = np.arange(-reach, reach + 1)
    weight = np.exp(-0.5 * (offset / sigma) ** 2)
    weight /= weight.sum()
    m = np.zeros((n, n))
    for i in range(n):
        np.add.at(m[i], np.clip(i + offset, 0, n - 1), weight)
    _MATRICES[n, sigma] = m
    return m


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    h, w = image.shape
    return blur_matrix(h, sigma) @ image @ blur_matrix(w, sigma).T


def soft_masks(labels: np.ndarray, sigma: float) -> dict[int, tuple[int, int, np.ndarray]]:
    """The blurred mask of every label where it is not zero: row and column of its first pixel, and values."""
    h, w = labels.shape
    down, across, reach = blur_matrix(h, sigma), blur_matrix(w, sigma), int(4 * sigma + 0.5)
    out = {}
    for k in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == k)
        y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
        ya, yb, xa, xb = max(y0 - reach, 0), min(y1 + reach, h), max(x0 - reach, 0), min(x1 + reach, w)
        mask = (labels[y0:y1, x0:x1] == k).astype(float)
        out[int(k)] = (int(ya), int(xa), down[ya:yb, y0:y1] @ mask @ across[xa:xb, x0:x1].T)
    return out


def best_product(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Largest product of two placed patches; zero where they do not meet."""
    y0, x0 = max(a[0], b[0]), max(a[1], b[1])
    y1, x1 = min(a[0] + a[2].shape[0], b[0] + b[2].shape[0]), min(a[1] + a[2].shape[1], b[1] + b[2].shape[1])
    if y1 <= y0 or x1 <= x0:
        return 0.0
    inside = lambda p: p[2][y0 - p[0]:y1 - p[0], x0 - p[1]:x1 - p[1]]
    return float((inside(a) * inside(b)).max())


def _neighbours(a: np.ndarray, fill, diagonal: bool) -> np.ndarray:
    """The shifted copies of an array, stacked: 4 or 8 neighbours."""
    p = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    steps = [(0, 1), (2, 1), (1, 0), (1, 2)] + ([(0, 0), (0, 2), (2, 0), (2, 2)] if diagonal else [])
    return np.stack([p[i:i + h, j:j + w] for i, j in steps])


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Connected components numbered from 1 in row order of their first pixel; 0 is background."""
    h, w = mask.shape
    none = h * w
    root = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        low = np.where(mask, np.minimum(root, _neighbours(root, none, diagonal).min(axis=0)), none)
        low = np.append(low.ravel(), none)[low]  # follow one pointer
        if (low == root).all():
            break
        root = low
    _, number = np.unique(np.append(root.ravel(), none), return_inverse=True)
    return np.where(mask, number[:-1].reshape(h, w) + 1, 0)


def without_border(mask: np.ndarray) -> np.ndarray:
    """Drop the components (8-neighbour) that touch the image border."""
    lab = components(mask, diagonal=True)
    edge = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    return mask & ~np.isin(lab, edge[edge > 0])


def disk(radius: float, strict: bool = False) -> list[tuple[int, int]]:
    r = int(np.ceil(radius))
    inside = (lambda d: d < radius * radius) if strict else (lambda d: d <= radius * radius)
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if inside(i * i + j * j)]


def _over(mask: np.ndarray, offsets, grow: bool) -> np.ndarray:
    """Dilate (any pixel of the offsets set) or erode (all set); outside never decides."""
    h, w = mask.shape
    r = max(max(abs(i), abs(j)) for i, j in offsets)
    p = np.pad(mask, r, constant_values=not grow)
    views = [p[r + i:r + i + h, r + j:r + j + w] for i, j in offsets]
    return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)


def opened(mask: np.ndarray, radius: float) -> np.ndarray:
    return _over(_over(mask, disk(radius), False), disk(radius), True)


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of every pixel to the nearest background pixel of the image; infinite where there is none.

    Two passes of lower envelopes: down the columns, then across the rows over the columns'
    parabolas, which stops at the shift that cannot lower any pixel any more.
    """
    h, w = mask.shape
    none = h * h + w * w
    at = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, -none, at), axis=0)
    below = np.minimum.accumulate(np.where(mask, none, at)[::-1], axis=0)[::-1]
    column = np.minimum(np.minimum(at - above, below - at).astype(float) ** 2, np.inf)
    column[column >= none] = np.inf
    out = column.copy()
    for k in range(1, w):
        if k * k >= out.max(initial=0):
            break
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + k * k)
    return out


def far_from_background(mask: np.ndarray, distance: float) -> np.ndarray:
    """Pixels at least ``distance`` away from every background pixel."""
    return squared_distance(mask) >= distance * distance


def at_least(lab: np.ndarray, size: int) -> np.ndarray:
    """Labels whose region has the given size; smaller regions become background."""
    count = np.bincount(lab.ravel())
    count[0] = 0
    return np.where(count[lab] >= size, lab, 0)


def spread(markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Grow markers step by step within a mask; the smaller label wins where two meet."""
    lab = np.where(mask, markers, 0)
    big = lab.max() + 1
    while True:
        near = _neighbours(np.where(lab > 0, lab, big), big, False).min(axis=0)
        new = np.where((lab == 0) & mask & (near < big), near, lab)
        if (new == lab).all():
            return lab
        lab = new


#: neighbours clockwise from the one above, one bit each
_AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _removable(*sides: int) -> np.ndarray:
    """By neighbours' bits: pixels of a border that hold nothing together, if two triples of sides (bits) are not set whole."""
    m = np.arange(256)
    count = lambda x: (x[:, None] >> np.arange(8) & 1).sum(axis=1)
    opens = count((m >> 1 | (m & 1) << 7) & ~m)  # changes from background to region on the way round
    free = np.logical_and.reduce([m & side != side for side in sides])
    return (count(m) >= 2) & (count(m) <= 6) & (opens == 1) & free


# above, right, below, left are the bits 1, 4, 16, 64
_PEELS = (_removable(1 + 4 + 16, 4 + 16 + 64), _removable(1 + 4 + 64, 1 + 16 + 64))


def thinned(lab: np.ndarray) -> np.ndarray:
    """The midlines of a label image: every region thinned to lines of one pixel, peeled from two sides in turn (parallel thinning of Zhang and Suen)."""
    h, w = lab.shape
    while True:
        before = lab
        for peel in _PEELS:
            p = np.pad(lab, 1, constant_values=0)
            bits = sum(((p[1 + i:1 + i + h, 1 + j:1 + j + w] == lab).astype(np.int64) << b for b, (i, j) in enumerate(_AROUND)))
            lab = np.where((lab > 0) & peel[bits], 0, lab)
        if (lab == before).all():
            return lab


def laplace_peaks(image: np.ndarray, sigmas, threshold: float) -> list[tuple[int, int, float]]:
    """Local maxima over space and scale of the negative, scale-normalised Laplacian of Gaussian."""
    levels = []
    for s in sigmas:
        b = blurred(image, s)
        ring = _neighbours(np.pad(b, 1, mode="edge"), 0, False)[:, 1:-1, 1:-1].sum(axis=0)
        # rounding keeps equal neighbours apart from rounding noise
        levels.append(np.round(s * s * (4 * b - ring), 9))
    cube = np.pad(np.stack(levels), 1, constant_values=-np.inf)
    view = np.lib.stride_tricks.sliding_window_view(cube, (3, 3, 3))
    top = view.max(axis=(3, 4, 5))
    core = cube[1:-1, 1:-1, 1:-1]
    return [(int(y), int(x), float(sigmas[k])) for k, y, x in np.argwhere((core >= top) & (core > threshold))]
