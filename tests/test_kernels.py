"""Image helpers against naive loops."""

import numpy as np
import pytest

from cellframe.functions import kernels as k


def flood(mask, steps):
    lab, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            i, j = todo.pop()
            if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not lab[i, j]:
                lab[i, j] = n
                todo += [(i + a, j + b) for a, b in steps]
    return lab


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("diagonal", [False, True])
def test_components(seed, diagonal):
    mask = np.random.default_rng(seed).random((13, 9)) < 0.55
    np.testing.assert_array_equal(k.components(mask, diagonal), flood(mask, EIGHT if diagonal else FOUR))


def test_components_of_nothing_and_everything():
    assert k.components(np.zeros((3, 4), bool)).max() == 0
    assert (k.components(np.ones((3, 4), bool)) == 1).all()


def test_without_border():
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = True      # joined diagonally to the border
    mask[3, 3] = True
    assert k.without_border(mask).sum() == 1 and k.without_border(mask)[3, 3]


def test_distance_and_opening():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    want = np.zeros_like(mask)
    want[3:6, 3:6] = True
    np.testing.assert_array_equal(k.far_from_background(mask, 2), want)
    spike = mask.copy()
    spike[4, 7:9] = True
    # the tip of a line one pixel wide goes, and so do the corners
    got = k.opened(spike, 1)
    assert not got[4, 8] and got[4, 2:8].all() and not got[2, 2]


def test_best_match_finds_a_shift():
    img = np.random.default_rng(1).random((12, 10))
    score, dy, dx = k.best_match(img, k.moved(img, 0, 0), 3)
    assert (round(score, 9), dy, dx) == (1.0, 0, 0)
    inner = np.random.default_rng(2).random((30, 30))
    image, template = inner[5:25, 5:25], inner[7:27, 4:24]
    padded = np.pad(image, 4, mode="reflect")
    naive = {(a - 4, b - 4): np.corrcoef(padded[a:a + 20, b:b + 20].ravel(), template.ravel())[0, 1] for a in range(9) for b in range(9)}
    score, dy, dx = k.best_match(image, template, 4)
    assert (dy, dx) == (2, -1) == max(naive, key=naive.get) and np.isclose(score, naive[2, -1])


def test_blur_keeps_constants_and_mass():
    assert np.allclose(k.blurred(np.full((5, 7), 3.0), 10), 3)
    spot = np.zeros((41, 41))
    spot[20, 20] = 1
    assert np.isclose(k.blurred(spot, 2).sum(), 1)


def test_spread_stays_in_mask():
    mask = np.array([[1, 1, 1, 0, 1]], bool)
    assert k.spread(np.array([[1, 0, 2, 0, 0]]), mask).tolist() == [[1, 1, 2, 0, 0]]


def test_peak_is_found_at_its_place():
    y, x = np.indices((25, 25))
    img = 100 * np.exp(-((y - 11) ** 2 + (x - 14) ** 2) / (2 * 2.0 ** 2))
    found = k.laplace_peaks(img, [1, 2, 3], 1.0)
    assert (11, 14) in {(a, b) for a, b, _ in found}
    best = max(found, key=lambda f: img[f[0], f[1]])
    assert best == (11, 14, 2.0)


def test_soft_masks_equal_whole_blurs():
    from cellframe.functions.kernels import best_product, blurred, soft_masks
    rng = np.random.default_rng(4)
    a, b = np.zeros((40, 30), int), np.zeros((40, 30), int)
    for img in (a, b):
        for k in (1, 2, 5):
            y, x = rng.integers(0, 34), rng.integers(0, 24)
            img[y:y + 5, x:x + 5] = k
    soft_a, soft_b = soft_masks(a, 1.0), soft_masks(b, 1.0)
    assert set(soft_a) == set(np.unique(a[a > 0]))
    for i, p in soft_a.items():
        for j, q in soft_b.items():
            want = (blurred((a == i).astype(float), 1.0) * blurred((b == j).astype(float), 1.0)).max()
            assert np.isclose(best_product(p, q), want, atol=1e-15)


def test_squared_distance_equals_brute_force():
    draw = np.random.default_rng(0)
    for _ in range(100):
        h, w = draw.integers(1, 12, 2)
        mask = draw.random((h, w)) < draw.choice([0.3, 0.7, 0.95, 1.0])
        background = np.argwhere(~mask)
        want = [[min([(y - a) ** 2 + (x - b) ** 2 for a, b in background], default=np.inf) for x in range(w)] for y in range(h)]
        assert (k.squared_distance(mask) == np.array(want, float)).all()


def test_midlines_follow_bent_regions_and_keep_labels_apart():
    lab = np.zeros((20, 30), int)
    lab[2:7, 2:25] = 1  # a bar with a second one at a right angle
    lab[2:18, 20:25] = 1
    lab[8:13, 2:15] = 2
    line = k.thinned(lab)
    assert set(np.unique(line)) == {0, 1, 2}
    assert (line[lab == 0] == 0).all() and (line[line > 0] == lab[line > 0]).all()
    # one connected line a region, a pixel wide, half a width from the sides, round the corner
    for n in (1, 2):
        assert k.components(line == n, diagonal=True).max() == 1
    assert (line == 2).sum(axis=0).max() == 1
    assert (line[4, 6:18] == 1).all() and (line[8:14, 22] == 1).all()
    assert not (k.thinned(np.ones((1, 1), int)) == 0).any()
