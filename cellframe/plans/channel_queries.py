"""Channel geometry, drift and picking."""

from pyspark.sql import functions as F

from ..operators import channels as c
from .image_queries import best_place_sql
from .registry import query

IMG = "fov:l peak:l t:l "
BOX = "min_row:l max_row:l min_col:l max_col:l"
_ROWS = "rows_ AS (SELECT fov, peak, t, y, sum(v) AS s FROM pixels GROUP BY fov, peak, t, y)"
_ENDS = """SELECT {k}, arg_max(y, (d, -y)) FILTER (y < 2) AS closed, arg_max(y, (-d, -y)) FILTER (y >= 5) AS open
  FROM (SELECT *, lead(s) OVER (PARTITION BY {k} ORDER BY y) - s AS d FROM {t}) q WHERE d IS NOT NULL GROUP BY {k}"""
_PEAKS = """cols_ AS (SELECT fov, peak, t, x, sum(v) AS s FROM pixels GROUP BY fov, peak, t, x),
ch AS (SELECT a.fov, a.peak, a.t, a.x, a.s FROM cols_ a WHERE a.x >= 1 AND 8 - a.x >= 1
  AND NOT EXISTS (SELECT 1 FROM cols_ b WHERE b.fov = a.fov AND b.peak = a.peak AND b.t = a.t
    AND ((b.x BETWEEN a.x - 2 AND a.x - 1 AND b.s >= a.s) OR (b.x BETWEEN a.x + 1 AND a.x + 2 AND b.s > a.s))))"""


def _peaks(d):
    return c.channel_peaks(c.projections(d.pixels, axis="x"), width=2, separation=2, image_width=8)


@query("g4_column_projection", IMG + "x:l s:l", "SELECT fov, peak, t, x, sum(v) AS s FROM pixels GROUP BY fov, peak, t, x", uses="pixels")
def _(d):
    return c.projections(d.pixels, axis="x")


@query("g4_row_projection", IMG + "y:l s:l", "SELECT fov, peak, t, y, sum(v) AS s FROM pixels GROUP BY fov, peak, t, y", uses="pixels")
def _(d):
    return c.projections(d.pixels, axis="y")


@query("g5_channel_ends", IMG + "x:l closed:l open:l", f"""{_ROWS}, {_PEAKS},
whole AS ({_ENDS.format(k='fov, peak, t', t='rows_')}),
slices AS (SELECT ch.fov, ch.peak, ch.t, ch.x, p.y, sum(p.v) AS s FROM ch JOIN pixels p ON p.fov = ch.fov AND p.peak = ch.peak
  AND p.t = ch.t AND p.x BETWEEN ch.x - 2 AND ch.x + 1 GROUP BY ch.fov, ch.peak, ch.t, ch.x, p.y),
own AS ({_ENDS.format(k='fov, peak, t, x', t='slices')}) ----
SELECT ch.fov, ch.peak, ch.t, ch.x, CASE WHEN ok THEN o.closed ELSE w.closed END AS closed, CASE WHEN ok THEN o.open ELSE w.open END AS open
FROM ch JOIN whole w USING (fov, peak, t) JOIN (SELECT o.*, abs((o.open - o.closed) - (w.open - w.closed)) <= 1
  AND o.closed >= 1 AND o.open <= 7 AS ok FROM own o JOIN whole w USING (fov, peak, t)) o USING (fov, peak, t, x)""", uses="pixels")
def _(d):
    return c.channel_ends(d.pixels, _peaks(d), height=8, half_width=2, tol=1, border=1)


@query("g6_channel_peaks", IMG + "x:l s:l", f"{_PEAKS} ---- SELECT * FROM ch", uses="pixels")
def _(d):
    return _peaks(d)


def _linked_sql(w: int, wider: int) -> str:
    """Ridges of one width from those of the next wider one."""
    return f"""near{w} AS (SELECT g.fov, g.peak, g.t, g.x, g.length, g.best, g.live, arg_min(m.x, (abs(m.x - g.x), m.x)) AS nx, arg_min(m.r, (abs(m.x - g.x), m.x)) AS nr
  FROM ridge{wider} g LEFT JOIN top m ON g.live AND m.w = {w} AND m.fov = g.fov AND m.peak = g.peak AND m.t = g.t AND abs(m.x - g.x) <= {max(1, w // 2)}
  GROUP BY g.fov, g.peak, g.t, g.x, g.length, g.best, g.live),
ridge{w} AS (SELECT fov, peak, t, coalesce(nx, x) AS x, length + CASE WHEN nx IS NULL THEN 0 ELSE 1 END AS length, greatest(best, nr) AS best, nx IS NOT NULL AS live FROM near{w}
  UNION ALL SELECT fov, peak, t, x, 1, r, true FROM top m WHERE w = {w} AND NOT EXISTS (SELECT 1 FROM near{w} n WHERE n.fov = m.fov AND n.peak = m.peak AND n.t = m.t AND n.nx = m.x))"""


@query("g6_ridge_peaks", IMG + "x:l length:l best:d", f"""cols_ AS (SELECT fov, peak, t, x, sum(v) AS s FROM pixels GROUP BY fov, peak, t, x),
level AS (SELECT fov, peak, t, avg(s) AS m FROM cols_ GROUP BY fov, peak, t),
resp AS (SELECT a.fov, a.peak, a.t, a.x, w, round(sum((b.s - m)*(1 - (b.x - a.x)*(b.x - a.x)/CAST(w*w AS DOUBLE))*exp(-(b.x - a.x)*(b.x - a.x)/(2E0*w*w))/sqrt(w)), 6) AS r
  FROM cols_ a JOIN cols_ b USING (fov, peak, t) JOIN level USING (fov, peak, t), (VALUES (1), (2), (3)) widths(w) WHERE abs(b.x - a.x) <= 4*w GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, lag(r) OVER z AS lo, lead(r) OVER z AS hi FROM resp WINDOW z AS (PARTITION BY fov, peak, t, w ORDER BY x))
  WHERE r > 0 AND (lo IS NULL OR r > lo) AND (hi IS NULL OR r >= hi)),
ridge3 AS (SELECT fov, peak, t, x, 1 AS length, r AS best, true AS live FROM top WHERE w = 3),
{_linked_sql(2, 3)}, {_linked_sql(1, 2)},
noise AS (SELECT fov, peak, t, a AS n FROM (SELECT fov, peak, t, abs(r) AS a, row_number() OVER (PARTITION BY fov, peak, t ORDER BY abs(r)) AS k,
  count(*) OVER (PARTITION BY fov, peak, t) AS c FROM resp WHERE w = 1) WHERE k = 1 + (c - 1) // 10) ----
SELECT fov, peak, t, x, max(length) AS length, max(best) AS best FROM ridge1 JOIN noise USING (fov, peak, t)
WHERE length >= 2 AND best >= 3*n AND x >= 1 AND 8 - x >= 1 GROUP BY fov, peak, t, x""", uses="pixels")
def _(d):
    return c.ridge_peaks(c.projections(d.pixels, axis="x"), widths=(1, 2, 3), separation=2, image_width=8, snr=3.0, min_length=2)


_MASKS = """clip AS (SELECT fov, greatest(min_col - 3, 0) AS x1, least(max_col + 3, 1024) AS x2, greatest(min_row - 10, 0) AS y1,
  least(max_row + 10, 360) AS y2 FROM boxes),
isl AS (SELECT *, sum(CASE WHEN x1 > r THEN 1 ELSE 0 END) OVER (PARTITION BY fov ORDER BY x1, k) AS g FROM (
  SELECT *, row_number() OVER (PARTITION BY fov ORDER BY x1) AS k,
    max(x2) OVER (PARTITION BY fov ORDER BY x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM clip) q),
masks AS (SELECT * FROM (SELECT fov, (min(x1) + max(x2) - 1) // 2 AS peak, min(y1) AS min_row, max(y2) - 1 AS max_row, min(x1) AS min_col,
  max(x2) - 1 AS max_col FROM isl GROUP BY fov, g) m WHERE min_col > 0 AND max_col < 1024)"""


def _masks(d):
    return c.consensus_masks(d.boxes, crop_pad=3, length_pad=10, shape=(360, 1024))


@query("g7_consensus_masks", "fov:l peak:l " + BOX, f"{_MASKS} ---- SELECT * FROM masks", uses="boxes")
def _(d):
    return _masks(d)


@query("g8_equalised_masks", "fov:l peak:l " + BOX, f"""{_MASKS},
m AS (SELECT *, (SELECT max(max_row - min_row) FROM masks) AS l, (SELECT max(max_col - min_col) FROM masks) - (max_col - min_col) AS more FROM masks) ----
SELECT fov, peak, min_row, min_row + l AS max_row, greatest(min_col - more // 2, 0) AS min_col,
  CASE WHEN more = 0 THEN max_col ELSE least(max_col + (more - more // 2), 1023) END AS max_col FROM m""", uses="boxes")
def _(d):
    return c.equalise_masks(_masks(d), n_cols=1024)


@query("g9_frame_masks", "fov:l peak:l t:l row_a:l row_b:l col_a:l col_b:l", """
SELECT fov, min_col AS peak, t, min_row AS row_a, max_row AS row_b, min_col AS col_a, max_col AS col_b FROM boxes""", uses="boxes")
def _(d):
    out = c.frame_masks(d.boxes.withColumn("peak", F.col("min_col")))
    return out.select("*", F.get("rows", F.lit(0)).alias("row_a"), F.get("rows", F.lit(1)).alias("row_b"),
                      F.get("cols", F.lit(0)).alias("col_a"), F.get("cols", F.lit(1)).alias("col_b"))


@query("g10_trap_boxes", IMG + "label:l " + BOX, """
SELECT * FROM (SELECT fov, peak, t, label, round_even(y, 0) - 2 AS min_row, round_even(x, 0) - 1 AS min_col, round_even(y, 0) + 2 AS max_row,
  round_even(x, 0) + 2 AS max_col FROM regions WHERE area >= 6) q
WHERE min_row >= 0 AND min_col >= 0 AND max_row <= 8 AND max_col <= 8""", uses="regions")
def _(d):
    return c.trap_boxes(d.regions, min_area=6, width=3, height=4, shape=(8, 8))


_SHIFTS = """shifts AS (SELECT r.fov, r.t, round_even(avg(r.y - f.y), 0) AS dy, round_even(avg(r.x - f.x), 0) AS dx
FROM regions r JOIN regions f ON f.fov = r.fov AND f.peak = r.peak AND f.label = r.label
WHERE f.t = (SELECT min(t) FROM regions m WHERE m.fov = r.fov) GROUP BY r.fov, r.t)"""


@query("g11_frame_shifts", "fov:l t:l dy:l dx:l", f"{_SHIFTS} ---- SELECT * FROM shifts", uses="regions")
def _(d):
    return c.frame_shifts(d.regions)


def _label_shifts(d):
    # a drift per field of view and frame, from the mean position of the bright pixels
    return d.labels.groupBy("fov", "t").agg(F.floor(F.avg("y") * 4 - 12).alias("dy"), F.floor(F.avg("x") * 4 - 12).alias("dx"))


@query("g12_shift_boxes", "fov:l peak:l t:l " + BOX, """
sh AS (SELECT fov, t, floor(avg(y)*4 - 12) AS dy, floor(avg(x)*4 - 12) AS dx FROM labels GROUP BY fov, t),
bx AS (SELECT fov, peak, peak AS min_row, 9 - peak AS min_col, 40 + peak AS max_row, 47 - peak AS max_col FROM specs),
mv AS (SELECT b.fov, b.peak, s.t, first, min_row + f*dy AS min_row, max_row + f*dy AS max_row, min_col + f*dx AS min_col, max_col + f*dx AS max_col
  FROM bx b JOIN (SELECT *, CASE WHEN t = min(t) OVER (PARTITION BY fov) THEN 0 ELSE 1 END AS f, t = min(t) OVER (PARTITION BY fov) AS first FROM sh) s USING (fov)) ----
SELECT * FROM mv WHERE (fov, peak) NOT IN (SELECT (fov, peak) FROM mv WHERE NOT first AND (least(min_row, min_col, max_row, max_col) < 0
  OR greatest(min_row, min_col, max_row, max_col) > 48))""", uses="labels specs")
def _(d):
    p = F.col("peak")
    boxes = d.specs.select("fov", "peak", p.alias("min_row"), (9 - p).alias("min_col"), (40 + p).alias("max_row"), (47 - p).alias("max_col"))
    return c.shift_boxes(boxes, _label_shifts(d), size=48)


@query("g13_full_area_tracks", IMG + "label:l area:l", """
SELECT r.* FROM regions r JOIN (SELECT fov, t, label FROM regions GROUP BY fov, t, label HAVING sum(area) = 80) k USING (fov, t, label)""",
       uses="regions")
def _(d):
    return c.full_area_tracks(d.regions, area=80, keys=["fov", "t", "label"])


@query("g14_fill_missing_frames", IMG + "source_t:l label:l area:l", """
f AS (SELECT DISTINCT fov, peak, 3*t + k AS t FROM pixels, (SELECT unnest([-1, 0, 1]) AS k) s), det AS (SELECT * REPLACE (3*t AS t) FROM regions),
dt AS (SELECT DISTINCT fov, peak, t FROM det),
src AS (SELECT f.fov, f.peak, f.t, coalesce((SELECT max(t) FROM dt WHERE dt.fov = f.fov AND dt.peak = f.peak AND dt.t <= f.t),
  CASE WHEN f.t = (SELECT min(g.t) FROM f g WHERE g.fov = f.fov AND g.peak = f.peak) THEN
   (SELECT max(t) FROM dt WHERE dt.fov = f.fov AND dt.peak = f.peak AND dt.t = f.t + 1) END) AS s FROM f) ----
SELECT s.fov, s.peak, s.t, s.s AS source_t, d.label, d.area FROM src s JOIN det d ON d.fov = s.fov AND d.peak = s.peak AND d.t = s.s""",
       uses="pixels regions")
def _(d):
    # a detection in every third frame only
    frames = d.stacks.select("fov", "peak", F.explode(F.array(*[3 * F.col("t") + k for k in (-1, 0, 1)])).alias("t"))
    return c.fill_missing_frames(frames, d.regions.withColumn("t", 3 * F.col("t")))


_FIRST = "arg_max(y, (s, -y))"


@query("g15_orientation", IMG + "flip:l", f"""
SELECT fov, peak, t, CASE WHEN {_FIRST} < 4 THEN 1 ELSE 0 END AS flip FROM (SELECT fov, peak, t, y, sum(v)/8.0E0 AS s FROM pixels GROUP BY ALL) q
GROUP BY fov, peak, t""", uses="pixels")
def _(d):
    return c.orientation(d.pixels, height=8)


@query("g15_orientation_by_profile", IMG + "flip:l", f"""
SELECT fov, peak, t, CASE WHEN {_FIRST} <= 4 THEN 1 ELSE 0 END AS flip FROM (SELECT fov, peak, t, y, median(v) AS s FROM pixels GROUP BY ALL) q
GROUP BY fov, peak, t""", uses="pixels")
def _(d):
    return c.orientation(d.pixels, height=8, mode="profile")


@query("g15_flip_rows", IMG + "y:l x:l v:l", f"""
o AS (SELECT fov, peak, t, {_FIRST} < 4 AS flip FROM (SELECT fov, peak, t, y, sum(v)/8.0E0 AS s FROM pixels GROUP BY ALL) q GROUP BY fov, peak, t) ----
SELECT p.fov, p.peak, p.t, CASE WHEN flip THEN 7 - y ELSE y END AS y, x, v FROM pixels p JOIN o USING (fov, peak, t)""", uses="pixels")
def _(d):
    return c.flip_rows(d.pixels, c.orientation(d.pixels, height=8), height=8)


@query("g16_phase_plane", IMG + "plane:s", """
SELECT fov, peak, t, CASE WHEN avg(v) >= avg(2000 - v) THEN 'c1' ELSE 'c2' END AS plane FROM pixels GROUP BY fov, peak, t""", uses="pixels")
def _(d):
    p = d.pixels
    return c.phase_plane(p.withColumn("plane", F.lit("c1")).unionByName(
        p.withColumn("v", 2000 - F.col("v")).withColumn("plane", F.lit("c2"))))


@query("g17_crop_channels", IMG + "y:l x:l v:l", """
fr AS (SELECT fov, t, y, peak*8 + x AS x, v FROM pixels),
mk AS (SELECT fov, peak, 1 AS min_row, 10 AS max_row, peak*8 + 1 AS min_col, peak*8 + 6 AS max_col FROM specs) ----
SELECT m.fov, m.peak, f.t, r.i - m.min_row AS y, f.x - m.min_col AS x, f.v FROM mk m, (SELECT unnest(range(0, 20)) AS i) r
JOIN fr f ON f.fov = m.fov AND f.y = least(r.i, 7) AND f.x >= m.min_col AND f.x < m.max_col WHERE r.i >= m.min_row AND r.i < m.max_row""",
       uses="pixels specs")
def _(d):
    p = F.col("peak").cast("int")
    # full frames: the ten channels of a field of view side by side
    side = F.map_from_entries(F.collect_list(F.struct("peak", "px")))
    none = F.array_repeat(F.lit(None).cast("int"), 8)
    line = lambda y: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.coalesce(F.slice(F.col("m")[k], y * 8 + 1, F.lit(8)), none)))
    frames = d.stacks.groupBy("fov", "t").agg(side.alias("m")).select(
        "fov", "t", F.lit(8).alias("height"), F.lit(80).alias("width"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), line)).alias("px"))
    masks = d.specs.select("fov", "peak", F.lit(1).alias("min_row"), F.lit(10).alias("max_row"),
                           (p * 8 + 1).alias("min_col"), (p * 8 + 6).alias("max_col"))
    cut_out = c.crop_channels(frames, masks).select("*", F.posexplode("px").alias("i", "v")).where("v IS NOT NULL")
    i, w = F.col("i"), F.col("width")
    return cut_out.select("fov", "peak", "t", F.floor(i / w).alias("y"), (i % w + F.col("left")).alias("x"), "v")


@query("g18_channel_correlation", IMG + "score:d", f"""
smp AS (SELECT fov, peak, t FROM (SELECT *, row_number() OVER (PARTITION BY fov, peak ORDER BY t) - 1 AS k,
  count(*) OVER (PARTITION BY fov, peak) AS n FROM (SELECT DISTINCT fov, peak, t FROM pixels) o) q
  WHERE k % greatest(n // 20, 1) = 0 AND k // greatest(n // 20, 1) < 20),
tem AS (SELECT p.* FROM pixels p JOIN smp USING (fov, peak, t)),
ref AS (SELECT s.fov, s.peak, s.t, p.y, p.x, p.v FROM smp s JOIN (SELECT fov, peak, min(t) AS t0 FROM smp GROUP BY fov, peak) f USING (fov, peak)
  JOIN pixels p ON p.fov = s.fov AND p.peak = s.peak AND p.t = f.t0),
{best_place_sql('ref', 'tem')} ---- SELECT fov, peak, t, s AS score FROM best""", uses="pixels")
def _(d):
    return c.channel_xcorr(d.stacks, pad=2)


def _scores(d):
    return d.regions.select("fov", "peak", (F.col("area") / 16).alias("score"))


@query("g19_pick_by_correlation", "fov:l peak:l spec:l", """
SELECT fov, peak, CASE WHEN avg(area/16.0E0) < 0.5 THEN 1 ELSE -1 END AS spec FROM regions GROUP BY fov, peak""", uses="regions")
def _(d):
    return c.pick_channels(_scores(d), method="correlation", threshold=0.5)


@query("g19_pick_by_probability", "fov:l peak:l spec:l", """
SELECT fov, peak, CASE WHEN avg(area/16.0E0) > 0.5 THEN 1 ELSE -1 END AS spec FROM regions GROUP BY fov, peak""", uses="regions")
def _(d):
    return c.pick_channels(_scores(d), method="probability", threshold=0.5)


@query("g19_pick_by_count", "fov:l peak:l spec:l", """
SELECT fov, peak, CASE WHEN max(CASE WHEN area > 14 THEN label ELSE 0 END) > 0 THEN 1 ELSE -1 END AS spec FROM regions GROUP BY fov, peak""",
       uses="regions")
def _(d):
    return c.pick_channels(d.regions.withColumn("score", F.when(F.col("area") > 14, F.col("label")).otherwise(0)), method="count")


@query("g20_channel_summary", "fov:l analysed:l empty:l ignored:l", """
SELECT fov, sum(CASE WHEN spec = 1 THEN 1 ELSE 0 END) AS analysed, sum(CASE WHEN spec = 0 THEN 1 ELSE 0 END) AS empty,
  sum(CASE WHEN spec = -1 THEN 1 ELSE 0 END) AS ignored FROM specs GROUP BY fov""", uses="specs")
def _(d):
    return c.channel_summary(d.specs)


@query("g21_max_label", IMG + "n_cells:l", "SELECT fov, peak, t, max(label) AS n_cells FROM labels GROUP BY fov, peak, t", uses="labels")
def _(d):
    return c.max_label(d.labels)


@query("g22_intensity_range", "low:d high:d mean_high:d", """
SELECT avg(lo) AS low, min(hi) AS high, avg(hi) AS mean_high FROM (SELECT min(v) AS lo, max(v) AS hi FROM pixels GROUP BY fov, peak, t) q""",
       uses="pixels")
def _(d):
    return c.intensity_range(d.pixels)
