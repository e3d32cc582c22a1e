"""Spot detection, assignment and linking on small images with known answers."""

import numpy as np
import pytest

from cellframe.operators import foci as f
from cellframe.operators import regions as r

IMAGES = "fov int, peak int, t int, height int, width int, px array<double>"
LABELS = "fov int, peak int, t int, height int, width int, lab array<int>"


def spot(y, x, height=100.0, sigma=1.5, shape=(40, 24)):
    i, j = np.indices(shape)
    return height * np.exp(-((i - y) ** 2 + (j - x) ** 2) / (2 * sigma ** 2))


@pytest.fixture(scope="module")
def found(spark):
    img = spot(10, 8) + spot(29, 14)
    lab = np.zeros(img.shape, int)
    lab[2:19, 2:22], lab[21:39, 2:22] = 1, 2
    stacks = spark.createDataFrame([(1, 0, 1, 40, 24, img.ravel().tolist())], IMAGES)
    labels = spark.createDataFrame([(1, 0, 1, 40, 24, lab.ravel().tolist())], LABELS)
    return f.detect_foci(stacks, labels, min_sigma=1, max_sigma=3, threshold=5).toPandas()


def test_each_cell_has_its_spot(found):
    assert sorted(found["label"]) == [1, 2]
    # the patch around a spot has an even number of pixels, so its centroid lies within one pixel
    for label, y, x in ((1, 10, 8), (2, 29, 14)):
        row = found[found["label"] == label].iloc[0]
        assert abs(row.fy - y) < 1 and abs(row.fx - x) < 1 and row.height == pytest.approx(100, rel=1e-6)


def test_dark_images_have_no_foci(spark):
    stacks = spark.createDataFrame([(1, 0, 1, 4, 4, [0.0] * 16)], IMAGES)
    labels = spark.createDataFrame([(1, 0, 1, 4, 4, [1] * 16)], LABELS)
    assert f.detect_foci(stacks, labels).count() == 0


def test_links_follow_the_nearer_focus(spark):
    def frame(t, *places):
        lab = np.zeros((20, 12), int)
        for k, (y, x) in enumerate(places, 1):
            lab[y:y + 2, x:x + 2] = k
        return (1, 0, t, 20, 12, lab.ravel().tolist())

    images = spark.createDataFrame([frame(1, (3, 3), (14, 3)), frame(2, (4, 3), (13, 4)), frame(3, (12, 4))], LABELS)
    valid = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 1, 2), (1, 0, 2, 1), (1, 0, 2, 2), (1, 0, 3, 1)],
                                  "fov int, peak int, t int, label int")
    got = {(x.t, x.label): x.focus_id for x in f.link_foci(images, valid).collect()}
    assert got[2, 1] == got[1, 1] and got[2, 2] == got[1, 2] == got[3, 1] != got[1, 1]


def test_feret_of_an_upright_box(spark):
    px = spark.createDataFrame([(1, 0, 1, y, x, 1) for y in range(3, 23) for x in range(5, 11)],
                               "fov int, peak int, t int, y int, x int, label int")
    row = r.feret(px, r.region_props(px)).first()
    assert 18 <= row.length <= 20 and 4.9 <= row.width <= 5.4


def test_foci_that_meet_merge_into_the_better_scored(spark):
    """a and b meet in frame 3, where b goes on; c joins b in frame 5 by way of d, which began there; e ends alone."""
    linked = [(1, 0, t, label, name) for name, label, times in (("a", 1, (1, 2)), ("b", 2, (1, 2, 3, 4)), ("c", 3, (2, 3, 4)), ("d", 1, (5, 6)), ("e", 4, (1,))) for t in times]
    scores = [(1, 0, 3, 2, 1, 0.4), (1, 0, 3, 2, 2, 0.9), (1, 0, 3, 3, 3, 0.7), (1, 0, 4, 2, 2, 0.9), (1, 0, 5, 1, 2, 0.5), (1, 0, 5, 1, 3, 0.5), (1, 0, 6, 1, 1, 0.8),
              (1, 0, 2, 1, 1, 0.9), (1, 0, 2, 2, 2, 0.9), (1, 0, 2, 4, 4, 0.0)]
    image = "fov int, peak int, t int, label int, "
    got = f.focus_merges(spark.createDataFrame(scores, image + "prev_label int, score double"), spark.createDataFrame(linked, image + "focus_id string"))
    rows = {r.focus_id: tuple(r)[3:] for r in got.collect()}
    assert rows == {"a": ("b", 3, True, "d", 2, 0), "b": ("d", 5, True, "d", 1, 1), "c": ("d", 5, True, "d", 1, 0), "d": (None, None, False, "d", 0, 2),
                    "e": (None, None, False, "e", 0, 0)}
    empty = f.focus_merges(spark.createDataFrame([], image + "prev_label int, score double"), spark.createDataFrame(linked[:2], image + "focus_id string"))
    assert [tuple(r)[3:] for r in empty.collect()] == [(None, None, False, "a", 0, 0)]
