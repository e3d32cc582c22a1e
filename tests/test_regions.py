import random

import pandas as pd

from cellframe.operators import regions as r
from cellframe.operators import segment


def test_equal_shapes_have_equal_axes(spark):
    """However the pixels are dealt and ordered, to the last bit: growth limits are met exactly by some pairs of regions."""
    rng = random.Random(3)
    shapes = [rng.sample([(y, x) for y in range(6) for x in range(4)], rng.randint(1, 20)) for _ in range(150)]
    px = [(1, 1, t, 1, y, x) for t, s in enumerate(shapes) for y, x in sorted(s)]
    axes = []
    for rows, parts in ((px, 1), (px[::-1], 1), (rng.sample(px, len(px)), 7)):
        df = spark.createDataFrame(rows, "fov int, peak int, t int, label int, y int, x int").repartition(parts)
        axes.append({p.t: (p.major, p.minor, p.orientation) for p in r.region_props(df).collect()})
    assert axes[0] == axes[1] == axes[2]
    for t, s in enumerate(shapes):
        n = len(s)
        vy, vx = (sum(v * v for v in c) / n - (sum(c) / n) ** 2 for c in zip(*s))
        assert abs((axes[0][t][0] ** 2 + axes[0][t][1] ** 2) / 16 - (vy + vx)) < 1e-9


def test_pixels_without_a_coordinate(spark):
    rows = [(1, 1, 0, 1, y, x) for y, x in ((0, 0), (1, None), (2, 0), (None, 3))]
    p = r.region_props(spark.createDataFrame(rows, "fov int, peak int, t int, label int, y int, x int")).first()
    assert (p.area, p.y, p.x, p.min_y, p.max_x) == (4, 1.0, 1.0, 0, 4)
    assert abs((p.major ** 2 + p.minor ** 2) / 16 - (2 / 3 + 2.0)) < 1e-9


def test_images_are_handed_back_in_pieces():
    b = pd.DataFrame({"t": range(1000), "height": 64, "width": 64})
    parts = list(segment.pieces([b, b[:0], b.assign(height=4000, width=4000)[:3]]))
    assert [t for p in parts for t in p["t"]] == [*range(1000), 0, 1, 2]
    assert all(len(p) == 1 or (p["height"] * p["width"]).sum() <= segment.PIECE for p in parts)
