"""Background, segmentation and region queries on images."""

from pyspark.sql import functions as F

from ..functions.expr import volume
from ..functions.lineage_cut import cut
from ..operators import background as b
from ..operators import regions as r
from ..operators import segment as s
from .registry import query

IMG = "fov:l peak:l t:l "
PX = IMG + "y:l x:l "
REG = IMG + "label:l "

_EMPTY = """em AS (SELECT fov, t, y, x, CAST(floor(avg(v)) AS INT) AS empty FROM pixels
  WHERE (fov, peak) IN (SELECT (fov, peak) FROM specs WHERE spec = 0) GROUP BY fov, t, y, x)"""




def best_place_sql(image, template):
    """Best offset of a template in the reflected image, both given as (fov, peak, t, y, x, v) tables."""
    back = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"
    return f"""win AS (SELECT q.fov, q.peak, q.t, o.a, o.b, q.v AS tv, p.v AS pv FROM {template} q
  JOIN (SELECT a, b FROM (SELECT unnest(range(-2, 3)) AS a) r1, (SELECT unnest(range(-2, 3)) AS b) r2) o ON true
  JOIN {image} p ON p.fov = q.fov AND p.peak = q.peak AND p.t = q.t AND p.y = {back('q.y + o.a')} AND p.x = {back('q.x + o.b')}),
place AS (SELECT fov, peak, t, a, b, (sum(pv*tv) - sum(pv)*sum(tv)/64.0E0)/sqrt((sum(pv*pv) - sum(pv)*sum(pv)/64.0E0)*(sum(tv*tv) - sum(tv)*sum(tv)/64.0E0)) AS s
  FROM win GROUP BY fov, peak, t, a, b),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fov, peak, t ORDER BY round(s, 12) DESC, a, b) AS k FROM place) q WHERE k = 1)"""


def mirrored(e):
    return f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END)"


def _empties(d):
    return b.average_empties(d.pixels, d.specs)


@query("b1_average_empties", "fov:l t:l y:l x:l empty:l", f"{_EMPTY} ---- SELECT * FROM em", uses="pixels specs")
def _(d):
    return _empties(d)


@query("b1_average_many_empties", "fov:l t:l y:l x:l empty:l", """
SELECT fov, t, y, x, CAST(floor(avg(v)) AS INT) AS empty FROM pixels WHERE (fov, peak) IN (SELECT (fov, peak) FROM specs WHERE spec = 1)
GROUP BY fov, t, y, x""", uses="pixels specs")
def _(d):
    return b.average_empties(d.pixels, d.specs.withColumn("spec", 1 - F.col("spec")))


@query("b2_average_empties_aligned", "fov:l t:l y:l x:l empty:l", f"""
ep AS (SELECT * FROM pixels WHERE (fov, peak) IN (SELECT (fov, peak) FROM specs WHERE spec = 1)),
ref AS (SELECT e.fov, e.peak, e.t, p.y, p.x, p.v FROM (SELECT DISTINCT fov, peak, t FROM ep) e
  JOIN (SELECT fov, t, min(peak) AS first FROM ep GROUP BY fov, t) f USING (fov, t)
  JOIN ep p ON p.fov = f.fov AND p.t = f.t AND p.peak = f.first),
{best_place_sql('ref', 'ep')} ----
SELECT g.fov, g.t, g.y, g.x, CAST(floor(avg(p.v)) AS INT) AS empty FROM (SELECT fov, peak, t, y, x FROM ep) g JOIN best k USING (fov, peak, t)
JOIN ep p ON p.fov = g.fov AND p.peak = g.peak AND p.t = g.t AND p.y = {mirrored('g.y - k.a')} AND p.x = {mirrored('g.x - k.b')}
GROUP BY g.fov, g.t, g.y, g.x""", uses="pixels specs")
def _(d):
    return b.average_empties_aligned(d.stacks, d.specs.withColumn("spec", 1 - F.col("spec")), pad=2)


@query("b3_borrow_empties", "fov:l t:l y:l x:l empty:l", f"""{_EMPTY} ----
SELECT * FROM em UNION ALL SELECT 6, t, y, x, empty FROM em WHERE fov = 2""", uses="pixels specs")
def _(d):
    mapping = d.spark.createDataFrame([(2, 6), (3, 1)], "from_fov int, to_fov int")
    return b.borrow_empties(_empties(d), mapping)


@query("b4_subtract_fluor", PX + "v:l", f"""{_EMPTY} ----
SELECT p.fov, p.peak, p.t, p.y, p.x, CASE WHEN e.empty IS NOT NULL THEN greatest(p.v - e.empty, 0) END AS v FROM pixels p LEFT JOIN em e
  ON e.fov = p.fov AND e.t = p.t AND e.y = greatest(least(p.y - 1, 5), 0) AND e.x = greatest(least(p.x - 1, 4), 0)""", uses="pixels specs")
def _(d):
    return b.subtract_fluor(d.pixels, _empties(d), size=(8, 8), empty_size=(6, 5))


@query("b5_subtract_phase", PX + "v:l", f"""{_EMPTY},
tem AS (SELECT i.fov, i.peak, i.t, e.y, e.x, e.empty AS v FROM (SELECT DISTINCT fov, peak, t FROM pixels) i JOIN em e USING (fov, t)),
{best_place_sql('pixels', 'tem')} ----
SELECT g.fov, g.peak, g.t, g.y, g.x, greatest(e.v - g.v, 0) AS v FROM pixels g JOIN best k USING (fov, peak, t)
JOIN tem e ON e.fov = g.fov AND e.peak = g.peak AND e.t = g.t AND e.y = {mirrored('g.y - k.a')} AND e.x = {mirrored('g.x - k.b')}""", uses="pixels specs")
def _(d):
    return b.explode_pixels(b.subtract_phase(d.stacks, _empties(d), pad=2))


_MED = """med AS (SELECT p.fov, p.peak, p.t, p.y, p.x, any_value(p.v) AS raw, CAST(median(q.v) AS INT) AS v FROM pixels p
  JOIN (SELECT 0 AS dy, 0 AS dx UNION ALL SELECT -1, 0 UNION ALL SELECT 1, 0 UNION ALL SELECT 0, -1 UNION ALL SELECT 0, 1) o ON true
  JOIN pixels q ON q.fov = p.fov AND q.peak = p.peak AND q.t = p.t
   AND q.y = greatest(least(p.y + o.dy, 7), 0) AND q.x = greatest(least(p.x + o.dx, 7), 0) GROUP BY p.fov, p.peak, p.t, p.y, p.x)"""


@query("b6_normalise", PX + "v:d", f"""{_MED} ----
SELECT m.fov, m.peak, m.t, m.y, m.x, least(m.raw/CAST(k.top AS DOUBLE), 1) AS v FROM med m
JOIN (SELECT fov, peak, max(v) AS top FROM med GROUP BY fov, peak) k USING (fov, peak)""", uses="pixels")
def _(d):
    return b.explode_pixels(b.normalise(d.stacks))


@query("b7_median_filter", PX + "v:l", f"{_MED} ---- SELECT * FROM med", uses="pixels")
def _(d):
    return b.explode_pixels(b.median_cross(d.stacks))


@query("b8_background_correction", PX + "v:d", f"""{_MED},
g AS (SELECT o, exp(-0.5E0*(o/10.0E0)*(o/10.0E0)) AS w FROM (SELECT unnest(range(-40, 41)) AS o) r),
k AS (SELECT i, greatest(least(i + o, 7), 0) AS j, sum(w)/(SELECT sum(w) FROM g) AS w FROM g, (SELECT unnest(range(0, 8)) AS i) r GROUP BY 1, 2),
h AS (SELECT m.fov, m.peak, m.t, m.y, k.i AS x, sum(k.w*m.v) AS v FROM med m JOIN k ON k.j = m.x GROUP BY m.fov, m.peak, m.t, m.y, k.i),
bl AS (SELECT h.fov, h.peak, h.t, k.i AS y, h.x, sum(k.w*h.v) AS v FROM h JOIN k ON k.j = h.y GROUP BY h.fov, h.peak, h.t, k.i, h.x) ----
SELECT m.fov, m.peak, m.t, m.y, m.x, m.v - bl.v AS v FROM med m JOIN bl USING (fov, peak, t, y, x)""", uses="pixels")
def _(d):
    return b.explode_pixels(b.background_correct(d.stacks, sigma=10))


def _obs(d):
    return d.regions.withColumn("volume", volume(F.col("major") + 1, F.col("minor") + 1))


@query("b9_region_intensity", REG + "total:l per_area:d per_volume:d", """
SELECT r.fov, r.peak, r.t, r.label, i.total, i.total/CAST(r.area AS DOUBLE) AS per_area,
  i.total/((r.major - r.minor)*pi()*(r.minor + 1)*(r.minor + 1)/4 + pi()/6*(r.minor + 1)*(r.minor + 1)*(r.minor + 1)) AS per_volume
FROM regions r JOIN (SELECT fov, peak, t, label, sum(v) AS total FROM labels JOIN pixels USING (fov, peak, t, y, x) GROUP BY ALL) i
USING (fov, peak, t, label)""", uses="regions")
def _(d):
    return b.region_intensity(d.stacks, d.label_images, _obs(d))


@query("b10_region_intensity_spread", REG + "median:d std:d", """
SELECT fov, peak, t, label, median(v) AS median, stddev_pop(v) AS std FROM labels JOIN pixels USING (fov, peak, t, y, x)
GROUP BY fov, peak, t, label""", uses="labels")
def _(d):
    return b.region_intensity_spread(d.stacks, d.label_images)


@query("b11_fluorescence_per_volume", "cell_id:l t:l fl_per_volume:d", """
SELECT cell_id, t, fl_total/((length - width)*pi()*width*width/4 + pi()/6*width*width*width) AS fl_per_volume FROM cell_obs""",
       uses="cell_obs")
def _(d):
    return b.fl_per_volume(d.cell_obs.withColumn("volume", volume("length", "width")))


@query("b12_midline_intensity", REG + "midline:d", """
SELECT r.fov, r.peak, r.t, r.label, coalesce(avg(CASE WHEN round(abs((l.x - r.x)*sin(r.orientation) + (l.y - r.y)*cos(r.orientation)), 9) <= 0.5
  THEN p.v END), 0) AS midline
FROM regions r JOIN labels l USING (fov, peak, t, label) JOIN pixels p ON p.fov = r.fov AND p.peak = r.peak AND p.t = r.t AND p.y = l.y AND p.x = l.x
GROUP BY r.fov, r.peak, r.t, r.label""", uses="regions")
def _(d):
    return b.midline_intensity(d.stacks, d.label_images, d.regions)


# bits of the eight neighbours by row and column; a step peels from two sides, and images of 8 x 8 need fewer steps than the limit
@query("b12_medial_axis_intensity", REG + "midline:d", """
th AS (SELECT fov, peak, t, label, y, x, 0 AS k FROM labels UNION ALL
  SELECT fov, peak, t, label, y, x, k + 1 FROM (
    SELECT s.fov, s.peak, s.t, s.label, s.y, s.x, s.k, CAST(coalesce(sum([128, 1, 2, 64, 0, 4, 32, 16, 8][3*(n.y - s.y) + n.x - s.x + 5]), 0) AS INT) AS m
    FROM th s LEFT JOIN th n ON n.fov = s.fov AND n.peak = s.peak AND n.t = s.t AND n.label = s.label AND abs(n.y - s.y) <= 1 AND abs(n.x - s.x) <= 1
    WHERE s.k < 32 GROUP BY ALL)
  WHERE NOT (bit_count(m) BETWEEN 2 AND 6 AND bit_count(((m // 2) | ((m % 2) * 128)) & (255 - m)) = 1
    AND CASE WHEN k % 2 = 0 THEN (m & 21) <> 21 AND (m & 84) <> 84 ELSE (m & 69) <> 69 AND (m & 81) <> 81 END)) ----
SELECT l.fov, l.peak, l.t, l.label, coalesce(avg(p.v) FILTER (th.k IS NOT NULL), 0) AS midline FROM labels l JOIN pixels p USING (fov, peak, t, y, x)
LEFT JOIN th ON th.fov = l.fov AND th.peak = l.peak AND th.t = l.t AND th.y = l.y AND th.x = l.x AND th.k = 32 GROUP BY ALL""", uses="labels pixels")
def _(d):
    return b.medial_axis_intensity(d.stacks, d.label_images)


# ---- segmentation ----

def _otsu_sql(hist):
    return f"""hist AS ({hist}),
cum AS (SELECT *, sum(n) OVER w AS w1, sum(n*c) OVER w AS s1, sum(n) OVER (PARTITION BY fov, peak, t) AS wn,
  sum(n*c) OVER (PARTITION BY fov, peak, t) AS sn FROM hist WINDOW w AS (PARTITION BY fov, peak, t ORDER BY c)),
otsu AS (SELECT fov, peak, t, arg_max(c, (round(w1*(wn - w1)*power(s1/w1 - (sn - s1)/(wn - w1), 2), 6), -c)) AS threshold
  FROM cum WHERE wn > w1 GROUP BY fov, peak, t)"""


_HIST = "SELECT fov, peak, t, CAST(v AS DOUBLE) AS c, count(*) AS n FROM pixels GROUP BY ALL"


@query("m1_otsu_threshold", IMG + "threshold:d", f"{_otsu_sql(_HIST)} ---- SELECT fov, peak, t, threshold*1.1E0 AS threshold FROM otsu", uses="pixels")
def _(d):
    return s.otsu(d.pixels, scale=1.1)


@query("m1_otsu_threshold_binned", IMG + "threshold:d", _otsu_sql("""
SELECT p.fov, p.peak, p.t, e.a + (least(floor((p.v - e.a)/((e.b - e.a)/16.0E0)), 15) + 0.5)*((e.b - e.a)/16.0E0) AS c, count(*) AS n
FROM pixels p JOIN (SELECT fov, peak, t, min(v) AS a, max(v) AS b FROM pixels GROUP BY ALL) e USING (fov, peak, t) GROUP BY ALL""")
       + " ---- SELECT * FROM otsu", uses="pixels")
def _(d):
    return s.otsu(d.pixels, bins=16)


@query("m2_binarise", PX + "mask:l", "SELECT *, CASE WHEN v/2000.0E0 >= 0.55 THEN 1 ELSE 0 END AS mask FROM pixels", uses="pixels")
def _(d):
    return s.binarise(d.pixels.withColumn("p", F.col("v") / 2000), threshold=0.55)


@query("m2_scale_probability", PX + "mask:l", "SELECT *, round_even(v/2000.0E0*100, 0) AS mask FROM pixels", uses="pixels")
def _(d):
    return s.binarise(d.pixels.withColumn("p", F.col("v") / 2000), threshold=None)


_COMP = """fg AS (SELECT fov, peak, t, y, x, y*8 + x AS i FROM pixels WHERE v > 1000),
reach AS (SELECT fov, peak, t, i, i AS j FROM fg
  UNION SELECT r.fov, r.peak, r.t, r.i, f.i FROM reach r JOIN fg f ON f.fov = r.fov AND f.peak = r.peak AND f.t = r.t
   AND ((f.i = r.j + 1 AND f.x > 0) OR (f.i = r.j - 1 AND f.x < 7) OR f.i = r.j + 8 OR f.i = r.j - 8)),
root AS (SELECT fov, peak, t, i, min(j) AS r FROM reach GROUP BY ALL),
comp AS (SELECT fov, peak, t, i // 8 AS y, i % 8 AS x, dense_rank() OVER (PARTITION BY fov, peak, t ORDER BY r) AS label FROM root)"""


@query("m3_connected_components", PX + "label:l", f"{_COMP} ---- SELECT * FROM comp", uses="pixels")
def _(d):
    return s.label_components(d.masks)


@query("m4_remove_small_objects", PX + "label:l", f"""{_COMP} ----
SELECT c.* FROM comp c JOIN (SELECT fov, peak, t, label FROM comp GROUP BY ALL HAVING count(*) >= 5) k USING (fov, peak, t, label)""",
       uses="pixels")
def _(d):
    return s.drop_small(s.label_components(d.masks), min_size=5)


@query("m4_small_holes", PX, _COMP.replace("v > 1000", "v <= 1000") + """ ----
SELECT c.* FROM comp c JOIN (SELECT fov, peak, t, label FROM comp GROUP BY ALL HAVING count(*) < 4
  AND min(y) > 0 AND max(y) < 7 AND min(x) > 0 AND max(x) < 7) k USING (fov, peak, t, label)""", uses="pixels")
def _(d):
    return s.holes(d.masks, height=8, width=8, max_size=4)


@query("m5_clear_border", PX + "label:l", f"""{_COMP} ----
SELECT c.* FROM comp c JOIN (SELECT fov, peak, t, label FROM comp GROUP BY ALL HAVING min(y) > 0 AND max(y) < 7 AND min(x) > 0 AND max(x) < 7) k
USING (fov, peak, t, label)""", uses="pixels")
def _(d):
    return s.clear_border(s.label_components(d.masks), height=8, width=8)


# without openings a segment is a component of at least two pixels away from the border
@query("m6_segment", PX + "label:l", f"""{_otsu_sql(_HIST)},
hi AS (SELECT p.fov, p.peak, p.t, p.y, p.x, p.y*8 + p.x AS i FROM pixels p JOIN otsu USING (fov, peak, t) WHERE p.v > threshold*1.12E0),
wide AS (SELECT fov, peak, t, i, i AS j FROM hi UNION SELECT r.fov, r.peak, r.t, r.i, h.i FROM wide r JOIN hi h ON h.fov = r.fov AND h.peak = r.peak AND h.t = r.t
  AND abs(h.y - r.j // 8) <= 1 AND abs(h.x - r.j % 8) <= 1),
inner_ AS (SELECT * FROM hi WHERE (fov, peak, t, i) NOT IN (SELECT (fov, peak, t, i) FROM wide WHERE j // 8 IN (0, 7) OR j % 8 IN (0, 7))),
near AS (SELECT fov, peak, t, i, i AS j FROM inner_ UNION SELECT r.fov, r.peak, r.t, r.i, h.i FROM near r JOIN inner_ h ON h.fov = r.fov AND h.peak = r.peak AND h.t = r.t
  AND abs(h.y - r.j // 8) + abs(h.x - r.j % 8) = 1),
root AS (SELECT fov, peak, t, i, min(j) AS r, count(*) AS n FROM near GROUP BY fov, peak, t, i) ----
SELECT fov, peak, t, i // 8 AS y, i % 8 AS x, dense_rank() OVER (PARTITION BY fov, peak, t ORDER BY r) AS label FROM root WHERE n >= 2""", uses="pixels")
def _(d):
    return s.segment(d.stacks, s.otsu(d.pixels, scale=1.12), open1=0, distance=1, open2=0, min_size=2)


# ---- segmentation with all its steps, on images of 64 x 64 in which every pixel of the table is a dome of 8 x 8

_BIG = """big AS (SELECT fov, peak, t, y*8 + i AS y, x*8 + j AS x, v - 2*((2*i - 7)*(2*i - 7) + (2*j - 7)*(2*j - 7)) AS v
  FROM pixels, unnest(range(8)) a(i), unnest(range(8)) b(j))"""
_AT = "n.fov = s.fov AND n.peak = s.peak AND n.t = s.t"


def _connected_sql(name: str, src: str, diagonal: int) -> str:
    """Pixels of ``src`` with the number of their component's first run of pixels in row order."""
    return f"""{name}_g AS (SELECT *, x - row_number() OVER (PARTITION BY fov, peak, t, y ORDER BY x) AS g FROM {src}),
{name}_r AS (SELECT fov, peak, t, y, g, min(x) AS a, max(x) AS b, row_number() OVER (PARTITION BY fov, peak, t ORDER BY y, min(x)) AS id FROM {name}_g GROUP BY fov, peak, t, y, g),
{name}_n AS (SELECT s.fov, s.peak, s.t, s.id, n.id AS other FROM {name}_r s JOIN {name}_r n ON {_AT} AND abs(s.y - n.y) = 1 AND s.a <= n.b + {diagonal} AND n.a <= s.b + {diagonal}),
{name}_c AS (SELECT fov, peak, t, id, id AS j FROM {name}_r UNION SELECT s.fov, s.peak, s.t, s.id, n.other FROM {name}_c s JOIN {name}_n n ON {_AT} AND n.id = s.j),
{name} AS (SELECT p.fov, p.peak, p.t, p.y, p.x, q.root FROM {name}_g p JOIN {name}_r r USING (fov, peak, t, y, g)
  JOIN (SELECT fov, peak, t, id, min(j) AS root FROM {name}_c GROUP BY ALL) q USING (fov, peak, t, id))"""


def _cleared_sql(name: str, src: str) -> str:
    """Pixels of components (8 neighbours) that keep off the border."""
    return f"""{_connected_sql(name + "_k", src, 1)},
{name} AS (SELECT fov, peak, t, y, x FROM (SELECT *, max(CASE WHEN y IN (0, 63) OR x IN (0, 63) THEN 1 ELSE 0 END) OVER (PARTITION BY fov, peak, t, root) AS edge FROM {name}_k) WHERE edge = 0)"""


def _shape_sql(name: str, src: str, within: str, grow: bool) -> str:
    """Erosion or dilation by the offsets (i, j) that satisfy ``within``; pixels outside the image never decide."""
    offsets = f"(SELECT i, j FROM unnest(range(-3, 4)) a(i), unnest(range(-3, 4)) b(j) WHERE {within}) o"
    moved = f"SELECT s.fov, s.peak, s.t, s.y, s.x, s.y + i AS ny, s.x + j AS nx FROM {src} s, {offsets} WHERE s.y + i BETWEEN 0 AND 63 AND s.x + j BETWEEN 0 AND 63"
    if grow:
        return f"{name} AS (SELECT DISTINCT fov, peak, t, ny AS y, nx AS x FROM ({moved}))"
    return f"""{name} AS (SELECT s.fov, s.peak, s.t, s.y, s.x FROM ({moved}) s LEFT JOIN {src} n ON {_AT} AND n.y = s.ny AND n.x = s.nx
  GROUP BY ALL HAVING count(*) = count(n.y))"""


@query("m6_segment_defaults", PX + "label:l", f"""{_BIG}, {_otsu_sql(_HIST.replace("pixels", "big"))},
hi AS (SELECT fov, peak, t, y, x FROM big JOIN otsu USING (fov, peak, t) WHERE v > threshold),
{_cleared_sql("mask", "hi")},
{_shape_sql("e1", "mask", "i*i + j*j <= 4", False)}, {_shape_sql("o1", "e1", "i*i + j*j <= 4", True)},
{_shape_sql("far", "o1", "i*i + j*j < 4", False)},
{_shape_sql("e2", "far", "i*i + j*j <= 1", False)}, {_shape_sql("o2", "e2", "i*i + j*j <= 1", True)},
{_cleared_sql("core", "o2")}, {_connected_sql("part", "core", 0)},
marker AS (SELECT fov, peak, t, y, x, dense_rank() OVER (PARTITION BY fov, peak, t ORDER BY root) AS label
  FROM (SELECT *, count(*) OVER (PARTITION BY fov, peak, t, root) AS size FROM part) WHERE size >= 25),
grown(fov, peak, t, y, x, label) USING KEY (fov, peak, t, y, x) AS (
  SELECT fov, peak, t, y, x, label FROM marker
  UNION
  SELECT n.fov, n.peak, n.t, n.y, n.x, min(s.label) FROM grown s JOIN mask n ON {_AT} AND abs(n.y - s.y) + abs(n.x - s.x) = 1
  LEFT JOIN recurring.grown d ON d.fov = n.fov AND d.peak = n.peak AND d.t = n.t AND d.y = n.y AND d.x = n.x WHERE d.y IS NULL GROUP BY ALL) ----
SELECT fov, peak, t, y, x, label FROM grown""", uses="pixels")
def _(d):
    def dome(v, i, j):
        return v - F.lit(2) * ((2 * i - 7) * (2 * i - 7) + (2 * j - 7) * (2 * j - 7))

    def pixel(at):
        y, x = F.floor(at / 64).cast("int"), (at % 64).cast("int")
        return dome(F.get("px", F.floor(y / 8).cast("int") * 8 + F.floor(x / 8).cast("int")), y % 8, x % 8)

    big = d.stacks.select(*s.IMAGE, F.lit(64).alias("height"), F.lit(64).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(4095)), pixel).alias("px"))
    big = cut(big)
    return s.segment(big, s.otsu(big.select(*s.IMAGE, F.explode("px").alias("v"))))


_TWO = """a AS (SELECT fov, peak, t, y, x FROM pixels WHERE v > 1000), bb AS (SELECT fov, peak, t, y, x FROM pixels WHERE v > 1050),
na AS (SELECT fov, peak, t, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT fov, peak, t, count(*) AS n FROM bb GROUP BY ALL),
ni AS (SELECT fov, peak, t, count(*) AS n FROM a JOIN bb USING (fov, peak, t, y, x) GROUP BY ALL)"""


def _both(d):
    return d.pixels.where("v > 1000"), d.pixels.where("v > 1050")


@query("m7_dice", IMG + "dice:d", f"""{_TWO} ----
SELECT fov, peak, t, 2.0E0*coalesce(ni.n, 0)/(coalesce(na.n, 0) + coalesce(nb.n, 0)) AS dice FROM na FULL JOIN nb USING (fov, peak, t)
LEFT JOIN ni USING (fov, peak, t)""", uses="pixels")
def _(d):
    return s.dice(*_both(d))


@query("m7_dice_smoothed", IMG + "dice:d", f"""{_TWO} ----
SELECT fov, peak, t, (2.0E0*coalesce(ni.n, 0) + 1)/(coalesce(na.n, 0) + coalesce(nb.n, 0) + 1) AS dice FROM na FULL JOIN nb USING (fov, peak, t)
LEFT JOIN ni USING (fov, peak, t)""", uses="pixels")
def _(d):
    return s.dice(*_both(d), smooth=1)


def _scored(d):
    return d.pixels.select(*b.IMAGE, (F.col("v") > 1000).cast("double").alias("y_true"), (F.col("v") / 2000).alias("y_pred"))


_SCORED = "z AS (SELECT fov, peak, t, CASE WHEN v > 1000 THEN 1.0E0 ELSE 0 END AS tr, v/2000.0E0 AS pr FROM pixels)"


@query("m8_mask_scores", IMG + "precision:d recall:d f1:d f2:d f05:d abs_diff:d", f"""{_SCORED},
c AS (SELECT fov, peak, t, sum(round_even(greatest(least(tr*pr, 1), 0), 0)) AS tp, sum(tr) AS pos, sum(round_even(greatest(least(pr, 1), 0), 0)) AS g,
  abs(sum(pr) - sum(tr))/count(*) AS abs_diff FROM z GROUP BY fov, peak, t),
q AS (SELECT *, tp/(g + 1e-7) AS p, tp/(pos + 1e-7) AS r FROM c) ----
SELECT fov, peak, t, p AS precision, r AS recall, 2*p*r/(p + r + 1e-7) AS f1, 5*p*r/(r + 4*p + 1e-7) AS f2, 1.25E0*p*r/(r + 0.25E0*p + 1e-7) AS f05,
  abs_diff FROM q""", uses="pixels")
def _(d):
    return s.mask_scores(_scored(d))


@query("m9_tversky", IMG + "tversky:d", f"""{_SCORED} ----
SELECT fov, peak, t, sum(tr*pr)/(sum(tr*pr) + 0.5*sum(pr*(1 - tr)) + 0.5*sum((1 - pr)*tr)) AS tversky FROM z GROUP BY fov, peak, t""", uses="pixels")
def _(d):
    return s.tversky(_scored(d))


# ---- regions ----

@query("r1_region_properties", REG + "area:l y:d x:d min_y:l min_x:l max_y:l max_x:l orientation:d major:d minor:d", "SELECT * FROM regions",
       uses="regions")
def _(d):
    return d.regions


def _near(y, x, cond, name):
    return f"arg_min(py, (round((py - ({y}))*(py - ({y})) + (px - ({x}))*(px - ({x})), 9), k)) FILTER ({cond}) AS {name}y, " \
           f"arg_min(px, (round((py - ({y}))*(py - ({y})) + (px - ({x}))*(px - ({x})), 9), k)) FILTER ({cond}) AS {name}x"


_H4, _H2 = "(k <= round_even(n/4.0E0, 0)) = up", "(k <= round_even(n/2.0E0, 0)) = up"
_CH = ", ".join(_near(f"y0 {'-' if g > 0 else '+'} si*0.2*len {'+' if w > 0 else '-'} co*0.6*minor",
                      f"x0 {'+' if g > 0 else '-'} co*0.2*len {'+' if w > 0 else '-'} si*0.6*minor",
                      _H2 if g > 0 else f"NOT ({_H2})", f"{nm}{m}")
                for nm, g in (("p", 1), ("q", -1)) for m, w in (("l", -1), ("r", 1)))


@query("r2_feret_size", REG + "length:d width:d", f"""
per AS (SELECT * FROM labels l WHERE (SELECT count(*) FROM labels m WHERE m.fov = l.fov AND m.peak = l.peak AND m.t = l.t AND m.label = l.label
  AND abs(m.y - l.y) + abs(m.x - l.x) = 1) < 4),
pts AS (SELECT p.fov, p.peak, p.t, p.label, p.y AS py, p.x AS px, row_number() OVER (PARTITION BY p.fov, p.peak, p.t, p.label ORDER BY p.y, p.x) AS k,
  count(*) OVER (PARTITION BY p.fov, p.peak, p.t, p.label) AS n, r.y AS y0, r.x AS x0, cos(r.orientation) AS co, sin(r.orientation) AS si, r.major, r.minor,
  r.orientation > 0 AS up FROM per p JOIN regions r USING (fov, peak, t, label)),
ends AS (SELECT fov, peak, t, label, {_near('y0 - si*0.6*major', 'x0 + co*0.6*major', _H4, 'a')},
  {_near('y0 + si*0.6*major', 'x0 - co*0.6*major', f'NOT ({_H4})', 'b')} FROM pts GROUP BY fov, peak, t, label),
le AS (SELECT fov, peak, t, label, sqrt((ay-by_)*(ay-by_) + (ax-bx)*(ax-bx)) AS len FROM (SELECT fov, peak, t, label, ay, ax, "by" AS by_, bx FROM ends) e),
ch AS (SELECT fov, peak, t, label, any_value(len) AS length, {_CH} FROM pts JOIN le USING (fov, peak, t, label) WHERE len IS NOT NULL GROUP BY fov, peak, t, label) ----
SELECT fov, peak, t, label, length, (sqrt((ply-pry)*(ply-pry) + (plx-prx)*(plx-prx)) + sqrt((qly-qry)*(qly-qry) + (qlx-qrx)*(qlx-qrx)))/2 AS width FROM ch""",
       uses="regions")
def _(d):
    return r.feret(d.labels, d.regions)


@query("r5_make_ids", REG + "cell_id:s", "SELECT fov, peak, t, label, 'exp_' || printf('f%02dp%04dt%04dr%02d', fov, peak, t, label) AS cell_id FROM regions",
       uses="regions")
def _(d):
    return r.make_id(d.regions, prefix="exp_")


@query("r5_parse_ids", REG + "cell_id:s", "SELECT fov, peak, t, label, printf('f%02dp%04dt%04dr%02d', fov, peak, t, label) AS cell_id FROM regions",
       uses="regions")
def _(d):
    return r.parse_id(r.make_id(d.regions).select("cell_id"))


@query("r6_frame_counts", IMG + "n:l pairs:l", """
f AS (SELECT fov, peak, t, count(*) AS n FROM regions GROUP BY ALL) ----
SELECT a.fov, a.peak, a.t, a.n, a.n*coalesce(b.n, 0) AS pairs FROM f a LEFT JOIN f b ON b.fov = a.fov AND b.peak = a.peak AND b.t = a.t + 1""",
       uses="regions")
def _(d):
    return r.frame_counts(d.regions)


@query("r7_region_pairs", REG + "next_label:l min_y:l max_y:l y:d area:l orientation:d next_min_y:l next_max_y:l next_y:d next_area:l next_orientation:d", """
SELECT a.fov, a.peak, a.t, a.label, b.label AS next_label, a.min_y, a.max_y, a.y, a.area, a.orientation, b.min_y AS next_min_y, b.max_y AS next_max_y,
  b.y AS next_y, b.area AS next_area, b.orientation AS next_orientation
FROM regions a JOIN regions b ON b.fov = a.fov AND b.peak = a.peak AND b.t = a.t + 1""", uses="regions")
def _(d):
    return r.region_pairs(d.regions)


@query("r8_context_window", IMG + "offset:l label:l area:d y:d orientation:d major:d max_x:d", """
SELECT f.fov, f.peak, f.t, o.o AS "offset", s.l AS label, coalesce(r.area, 0) AS area, coalesce(r.y, 0) AS y, coalesce(r.orientation, 0) AS orientation,
  coalesce(r.major, 0) AS major, coalesce(r.max_x, 0) AS max_x
FROM (SELECT DISTINCT fov, peak, t FROM pixels) f JOIN (SELECT unnest(range(-2, 3)) AS o) o ON true JOIN (SELECT unnest(range(1, 7)) AS l) s ON true
LEFT JOIN regions r ON r.fov = f.fov AND r.peak = f.peak AND r.t = f.t + o.o AND r.label = s.l""", uses="pixels regions")
def _(d):
    return r.context_window(d.regions, d.stacks, top=6)


@query("r9_classify_pairs", REG + "next_label:l interaction:s", """
SELECT * FROM (SELECT *, CASE WHEN p_migrate > 0.3 THEN 'migration' WHEN p_child > 0.3 THEN 'child' WHEN p_migrate + p_child > 0.3 THEN 'false_join' END AS interaction
  FROM probs) q WHERE interaction IS NOT NULL""", uses="probs")
def _(d):
    p = d.probs.select(*r.REGION, "next_label", F.col("p_migrate").alias("p_migration"), "p_child",
                       (F.col("p_migrate") + F.col("p_child")).alias("p_false_join"), F.lit(0.9).alias("p_none"))
    return r.classify_pairs(p, threshold=0.3)
