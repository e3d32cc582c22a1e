"""Foci, line profiles and ensembles."""

from pyspark.sql import functions as F

from ..functions.lineage_cut import cut
from ..operators import foci as f
from ..operators import profiles as p
from ..operators.background import region_intensity_spread
from .registry import query

REG = "fov:l peak:l t:l label:l "
_SPOT = """spot AS (SELECT fov, peak, t, label, arg_max(y, (v, -y, -x)) AS fy, arg_max(x, (v, -y, -x)) AS fx, max(v) AS height
  FROM labels JOIN pixels USING (fov, peak, t, y, x) GROUP BY fov, peak, t, label)"""


def _spots(d):
    from ..operators.background import region_pixels
    top = region_pixels(d.stacks, d.label_images).groupBy("fov", "peak", "t", "label").agg(
        F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m"))
    return top.select("fov", "peak", "t", "label", (-F.col("m.y")).alias("fy"), (-F.col("m.x")).alias("fx"), F.col("m.v").alias("height"))


@query("p1_focus_displacement", REG + "fy:l fx:l disp_l:d disp_w:d", f"""{_SPOT},
z AS (SELECT s.*, r.y AS cy, r.x AS cx, CASE WHEN r.orientation < 0 THEN r.orientation + pi() ELSE r.orientation END AS o
  FROM spot s JOIN regions r USING (fov, peak, t, label)) ----
SELECT fov, peak, t, label, fy, fx, (fy - cy)*sin(o) - (fx - cx)*cos(o) AS disp_l, (fy - cy)*cos(o) + (fx - cx)*sin(o) AS disp_w FROM z""", uses="regions")
def _(d):
    return f.focus_displacement(_spots(d), d.regions)


@query("p2_focus_filter", REG + "fy:l fx:l height:l", f"""{_SPOT} ----
SELECT s.* FROM spot s JOIN regions r USING (fov, peak, t, label)
JOIN (SELECT fov, peak, t, label, median(v) AS m FROM labels JOIN pixels USING (fov, peak, t, y, x) GROUP BY ALL) k USING (fov, peak, t, label)
WHERE s.fy > r.min_y AND s.fy < r.max_y AND s.fx > r.min_x AND s.fx < r.max_x AND s.height/k.m >= 1.15""", uses="regions")
def _(d):
    return f.focus_filter(_spots(d), d.regions, region_intensity_spread(d.stacks, d.label_images), ratio=1.15)


def _label_images(d):
    quadrant = lambda v, i: F.when(v > 1000, 1 + 2 * F.floor(i / 32) + F.floor((i % 8) / 4)).otherwise(0).cast("int")
    return d.stacks.select("fov", "peak", "t", "height", "width", F.transform("px", quadrant).alias("lab"))


_LAPLACE = """g AS (SELECT s, o, exp(-0.5E0*(o/CAST(s AS DOUBLE))*(o/CAST(s AS DOUBLE))) AS w FROM (SELECT 1 AS s, unnest(range(-4, 5)) AS o UNION ALL SELECT 2, unnest(range(-8, 9))) r),
kn AS (SELECT g.s, i, greatest(least(i + o, 7), 0) AS j, sum(w)/any_value(n) AS w FROM g JOIN (SELECT s, sum(w) AS n FROM g GROUP BY s) t USING (s),
  (SELECT unnest(range(0, 8)) AS i) r GROUP BY g.s, i, greatest(least(i + o, 7), 0)),
hz AS (SELECT l.fov, l.peak, l.t, l.label, kn.s, l.y, kn.i AS x, sum(kn.w*p.v) AS b FROM labels l JOIN pixels p USING (fov, peak, t, y, x) JOIN kn ON kn.j = l.x
  GROUP BY l.fov, l.peak, l.t, l.label, kn.s, l.y, kn.i),
bl AS (SELECT h.fov, h.peak, h.t, h.label, h.s, kn.i AS y, h.x, sum(kn.w*h.b) AS b FROM hz h JOIN kn ON kn.j = h.y AND kn.s = h.s GROUP BY h.fov, h.peak, h.t, h.label, h.s, kn.i, h.x),
st AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dy, dx)),
lp AS (SELECT a.fov, a.peak, a.t, a.label, a.s, a.y, a.x, round(a.s*a.s*(4*any_value(a.b) - sum(n.b)), 9) AS v FROM bl a, st
  JOIN bl n ON n.fov = a.fov AND n.peak = a.peak AND n.t = a.t AND n.label = a.label AND n.s = a.s AND n.y = greatest(least(a.y + dy, 7), 0) AND n.x = greatest(least(a.x + dx, 7), 0)
  GROUP BY a.fov, a.peak, a.t, a.label, a.s, a.y, a.x),
pk AS (SELECT a.* FROM lp a WHERE a.v > 10 AND NOT EXISTS (SELECT 1 FROM lp n WHERE n.fov = a.fov AND n.peak = a.peak AND n.t = a.t AND n.label = a.label
  AND abs(n.s - a.s) <= 1 AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 AND n.v > a.v)),
sp AS (SELECT k.fov, k.peak, k.t, k.label, k.s, k.y, k.x, sum(p.y*p.v)/CAST(sum(p.v) AS DOUBLE) AS fy, sum(p.x*p.v)/CAST(sum(p.v) AS DOUBLE) AS fx, max(p.v) AS height
  FROM pk k JOIN pixels p ON p.fov = k.fov AND p.peak = k.peak AND p.t = k.t AND p.y >= k.y - (k.s + 1) AND p.y < k.y + k.s + 1 AND p.x >= k.x - (k.s + 1) AND p.x < k.x + k.s + 1
  GROUP BY ALL HAVING sum(p.v) > 0),
wd AS (SELECT k.fov, k.peak, k.t, k.label, k.s, k.y, k.x, sqrt(sum(((p.y - k.fy)*(p.y - k.fy) + (p.x - k.fx)*(p.x - k.fx))*p.v)/CAST(sum(p.v) AS DOUBLE)/2) AS width
  FROM sp k JOIN pixels p ON p.fov = k.fov AND p.peak = k.peak AND p.t = k.t AND p.y >= k.y - (k.s + 1) AND p.y < k.y + k.s + 1 AND p.x >= k.x - (k.s + 1) AND p.x < k.x + k.s + 1
  GROUP BY ALL),
tt AS (SELECT k.fov, k.peak, k.t, k.label, k.s, k.y, k.x, sum(p.v) AS total FROM sp k JOIN pixels p ON p.fov = k.fov AND p.peak = k.peak AND p.t = k.t
  AND p.y >= k.y - 2 AND p.y < k.y + 2 AND p.x >= k.x - 2 AND p.x < k.x + 2 GROUP BY k.fov, k.peak, k.t, k.label, k.s, k.y, k.x)"""


@query("p3_detect_foci", REG + "fy:d fx:d sigma:d height:d width:d total:d", f"""{_LAPLACE} ----
SELECT fov, peak, t, label, sp.fy, sp.fx, s AS sigma, sp.height, wd.width, tt.total FROM sp JOIN wd USING (fov, peak, t, label, s, y, x) JOIN tt USING (fov, peak, t, label, s, y, x)""",
       uses="labels")
def _(d):
    return f.detect_foci(d.stacks, _label_images(d), min_sigma=1, max_sigma=2, threshold=10)


@query("p4_gaussian_moments", REG + "height:l cy:d cx:d width:d", """
z AS (SELECT * FROM labels JOIN pixels USING (fov, peak, t, y, x)),
m AS (SELECT fov, peak, t, label, max(v) AS height, sum(y*v)/CAST(sum(v) AS DOUBLE) AS cy, sum(x*v)/CAST(sum(v) AS DOUBLE) AS cx FROM z GROUP BY ALL),
w AS (SELECT fov, peak, t, label, sqrt(sum(abs((y - cx)*(y - cx)*v))/sum(v)) AS width FROM z JOIN m USING (fov, peak, t, label) WHERE x = floor(cx)
  GROUP BY fov, peak, t, label) ----
SELECT m.*, w.width FROM m LEFT JOIN w USING (fov, peak, t, label)""", uses="labels")
def _(d):
    from ..operators.background import region_pixels
    return f.moments(region_pixels(d.stacks, d.label_images), ["fov", "peak", "t", "label"])


# focus regions: bright pixels in three bands of rows; cells are the quadrants
_FPX = "fpx AS (SELECT fov, peak, t, y, x, 1 + y // 3 AS label FROM pixels WHERE v > 1080)"
_ASSIGN = """asg AS (SELECT * FROM (SELECT n.fov, n.peak, n.t, n.focus_label, n.label, n.n/CAST(a.n AS DOUBLE) AS share FROM
  (SELECT q.fov, q.peak, q.t, q.label AS focus_label, c.label, count(*) AS n FROM fpx q JOIN labels c USING (fov, peak, t, y, x) GROUP BY ALL) n
  JOIN (SELECT fov, peak, t, label AS focus_label, count(*) AS n FROM fpx GROUP BY ALL) a USING (fov, peak, t, focus_label)) k WHERE share >= 0.5)"""


def _focus_pixels(d):
    return d.pixels.where("v > 1080").select("fov", "peak", "t", "y", "x", (1 + F.floor(F.col("y") / 3)).cast("int").alias("label"))


def _focus_images(d):
    band = lambda v, i: F.when(v > 1080, 1 + F.floor(F.floor(i / 8) / 3)).otherwise(0).cast("int")
    return d.stacks.select("fov", "peak", "t", "height", "width", F.transform("px", band).alias("lab"))


@query("p6_assign_foci", "fov:l peak:l t:l focus_label:l label:l share:d", f"{_FPX}, {_ASSIGN} ---- SELECT * FROM asg", uses="labels")
def _(d):
    return f.assign_foci(_focus_pixels(d), d.labels)


_SOFT = f"""{_FPX}, {_ASSIGN},
g AS (SELECT o, exp(-0.5E0*o*o) AS w FROM (SELECT unnest(range(-4, 5)) AS o) r),
kn AS (SELECT i, greatest(least(i + o, 7), 0) AS j, sum(w)/(SELECT sum(w) FROM g) AS w FROM g, (SELECT unnest(range(0, 8)) AS i) r GROUP BY 1, 2),
soft AS (SELECT q.fov, q.peak, q.t, q.label, a.i AS y, b.i AS x, sum(a.w*b.w) AS s FROM fpx q JOIN kn a ON a.j = q.y JOIN kn b ON b.j = q.x GROUP BY ALL),
top AS (SELECT fov, peak, t, max(label) AS m FROM fpx GROUP BY ALL),
pr AS (SELECT n.fov, n.peak, n.t, l.l AS label, k.l AS prev_label FROM top n JOIN top o ON o.fov = n.fov AND o.peak = n.peak AND o.t = n.t - 1
  JOIN (SELECT unnest(range(1, 4)) AS l) l ON l.l <= n.m JOIN (SELECT unnest(range(1, 4)) AS l) k ON k.l <= o.m),
sc AS (SELECT pr.*, coalesce(x.s, 0) AS score FROM pr LEFT JOIN (SELECT a.fov, a.peak, a.t, a.label, b.label AS prev_label, max(a.s*b.s) AS s FROM soft a
  JOIN soft b ON b.fov = a.fov AND b.peak = a.peak AND b.t = a.t - 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL) x USING (fov, peak, t, label, prev_label))"""


@query("p5_focus_scores", REG + "prev_label:l score:d", f"{_SOFT} ---- SELECT * FROM sc WHERE score > 0", uses="labels")
def _(d):
    return f.focus_scores(_focus_images(d))


_CHAINS = f"""{_SOFT},
val AS (SELECT DISTINCT fov, peak, t, focus_label AS label, printf('f%02dp%04dt%04dr%02d', fov, peak, t, focus_label) AS id FROM asg),
bst AS (SELECT fov, peak, t, label, arg_min(prev_label, (round(-score, 9), prev_label)) AS prev_label FROM sc GROUP BY ALL HAVING max(score) - min(score) > 1e-9),
lk AS (SELECT v.id, b.id AS prev FROM val v JOIN bst USING (fov, peak, t, label) JOIN val b ON b.fov = v.fov AND b.peak = v.peak AND b.t = v.t - 1 AND b.label = bst.prev_label),
ch AS (SELECT id, id AS root, 0 AS steps FROM val WHERE id NOT IN (SELECT id FROM lk)
  UNION ALL SELECT l.id, c.root, c.steps + 1 FROM ch c JOIN lk l ON l.prev = c.id)"""


@query("p5_link_foci", REG + "focus_id:s steps:l", f"""{_CHAINS} ----
SELECT v.fov, v.peak, v.t, v.label, c.root AS focus_id, c.steps FROM val v JOIN ch c USING (id)""", uses="labels")
def _(d):
    valid = f.assign_foci(_focus_pixels(d), d.labels).select("fov", "peak", "t", F.col("focus_label").alias("label"))
    return f.link_foci(_focus_images(d), valid)


@query("p7_focus_merges", "focus_id:s appear_time:l last_time:l merge_partner:s merge_time:l ended_by_merge:l final_id:s n_merges:l n_merged_in:l", f"""{_CHAINS},
foc AS (SELECT v.fov, v.peak, v.t, v.label, c.root AS focus_id FROM val v JOIN ch c USING (id)),
life AS (SELECT focus_id, min(t) AS a, max(t) AS z FROM foc GROUP BY focus_id),
met AS (SELECT s.fov, s.peak, s.t, s.label, s.prev_label, s.score, n.focus_id AS into_id, p.focus_id AS from_id FROM sc s
  JOIN foc n ON n.fov = s.fov AND n.peak = s.peak AND n.t = s.t AND n.label = s.label
  JOIN foc p ON p.fov = s.fov AND p.peak = s.peak AND p.t = s.t - 1 AND p.label = s.prev_label WHERE s.score > 0),
jn AS (SELECT fov, peak, t, label FROM met GROUP BY ALL HAVING count(DISTINCT from_id) > 1),
mg AS (SELECT from_id AS focus_id, t, arg_min(into_id, (round(-score, 9), prev_label, label)) AS partner FROM met JOIN jn USING (fov, peak, t, label)
  JOIN life ON life.focus_id = from_id AND z + 1 = t GROUP BY from_id, t),
fl AS (SELECT focus_id, focus_id AS cur, 0 AS k FROM life UNION ALL SELECT fl.focus_id, mg.partner, k + 1 FROM fl JOIN mg ON mg.focus_id = fl.cur),
fin AS (SELECT focus_id, arg_max(cur, k) AS final_id, max(k) AS k FROM fl GROUP BY focus_id),
inn AS (SELECT partner AS focus_id, count(*) AS n FROM mg GROUP BY partner) ----
SELECT focus_id, a AS appear_time, z AS last_time, partner AS merge_partner, mg.t AS merge_time, CASE WHEN partner IS NULL THEN 0 ELSE 1 END AS ended_by_merge,
  final_id, k AS n_merges, coalesce(n, 0) AS n_merged_in FROM life LEFT JOIN mg USING (focus_id) JOIN fin USING (focus_id) LEFT JOIN inn USING (focus_id)""", uses="labels")
def _(d):
    valid = f.assign_foci(_focus_pixels(d), d.labels).select("fov", "peak", "t", F.col("focus_label").alias("label"))
    scores = cut(f.focus_scores(_focus_images(d)))
    return f.focus_merges(scores, f.link_foci(None, valid, scores=scores))


@query("p7_focus_tables", "focus_id:l parent_id:l appear_time:l appear_label:l last_time:l child1_id:l child2_id:l split_time:l disappear:l", """
seen AS (SELECT cell_id, min(t) AS a, arg_min(label, t) AS al, max(t) AS z, arg_min(length, t) AS y FROM cell_obs GROUP BY cell_id),
kid AS (SELECT c.parent_id, c.cell_id, s.a, row_number() OVER (PARTITION BY c.parent_id ORDER BY s.y, c.cell_id) AS k FROM cells c JOIN seen s USING (cell_id)
  WHERE c.parent_id IS NOT NULL),
kd AS (SELECT parent_id, max(CASE WHEN k = 1 THEN cell_id END) AS c1, max(CASE WHEN k = 2 THEN cell_id END) AS c2, min(a) AS sp FROM kid GROUP BY parent_id) ----
SELECT c.cell_id AS focus_id, c.parent_id, s.a AS appear_time, s.al AS appear_label, s.z AS last_time, kd.c1 AS child1_id, kd.c2 AS child2_id, kd.sp AS split_time,
  CASE WHEN kd.sp IS NULL THEN s.z END AS disappear FROM cells c JOIN seen s USING (cell_id) LEFT JOIN kd ON kd.parent_id = c.cell_id""", uses="cells cell_obs")
def _(d):
    return f.focus_tables(d.cells.select("cell_id", "parent_id"), d.cell_obs.withColumn("y", F.col("length")))


@query("p7_focus_long_table", "focus_id:l t:l length:d volume:d area:d seconds:l area_mean:d volume_mean:d total:d median:d sd:d disp_l:d disp_w:d", """
fo AS (SELECT o.* REPLACE (o.area*pi() AS area), f.disp_l, f.disp_w, (o.length - o.width)*pi()*o.width*o.width/4 + pi()/6*o.width*o.width*o.width AS volume
  FROM cell_obs o JOIN focus_obs f ON f.cell_id = o.cell_id AND f.t = o.t) ----
SELECT cell_id AS focus_id, t, length, volume, area, seconds, CASE WHEN area <> 0 THEN fl_total/area END AS area_mean, CASE WHEN volume <> 0 THEN fl_total/volume END AS volume_mean,
  fl_total AS total, length*10 AS median, width*10 AS sd, disp_l, disp_w FROM fo""", uses="cell_obs focus_obs")
def _(d):
    o = d.obs
    foci = o.join(d.foci_of(o).select("cell_id", "t", "disp_l", "disp_w"), ["cell_id", "t"])
    foci = foci.withColumns({"area": F.col("area") * F.pi(), "total_fl": F.col("fl_total"), "median_fl": F.col("length") * 10, "sd_fl": F.col("width") * 10})
    return f.focus_long_table(foci)


# ---- profiles ----

def _obs(d):
    return d.stored_regions.withColumns({"length": F.col("major"), "width": F.col("minor") + 1})


_AXIS = """ax AS (SELECT l.fov, l.peak, l.t, l.label, p.v, r.major AS len, r.minor + 1 AS wid,
  round(((l.x - r.x)*cos(r.orientation) - (l.y - r.y)*sin(r.orientation))*CASE WHEN r.orientation > 0 THEN -1 ELSE 1 END, 9) AS u,
  round(((l.x - r.x)*sin(r.orientation) + (l.y - r.y)*cos(r.orientation))*CASE WHEN r.orientation > 0 THEN -1 ELSE 1 END, 9) AS w
  FROM labels l JOIN pixels p USING (fov, peak, t, y, x) JOIN regions r USING (fov, peak, t, label)),
hs AS (SELECT unnest(range(-40, 41)) AS k)"""
_PROF = _AXIS + """,
pv AS (SELECT fov, peak, t, label, round_even(u, 0) AS k, avg(v) AS value FROM ax WHERE abs(w) <= round(wid*1.25/2, 9) AND abs(u) <= round((len + 4)/2, 9) GROUP BY ALL),
prof AS (SELECT r.fov, r.peak, r.t, r.label, hs.k + floor(round((r.major + 4)/2, 9)) AS pos, coalesce(pv.value, 0) AS value FROM regions r
  JOIN hs ON abs(hs.k) <= floor(round((r.major + 4)/2, 9)) LEFT JOIN pv ON pv.fov = r.fov AND pv.peak = r.peak AND pv.t = r.t AND pv.label = r.label AND pv.k = hs.k)"""


def _profile(d):
    return p.axis_profile(d.stacks, d.label_images, _obs(d))


@query("p8_axis_profile", REG + "pos:l value:d", f"{_PROF} ---- SELECT * FROM prof", uses="regions")
def _(d):
    return _profile(d)


@query("p9_ring", REG + "location:l height:d median:d width:d", f"""{_PROF},
tp AS (SELECT fov, peak, t, label, max(value) AS height, arg_max(pos, (value, -pos)) AS m, median(CASE WHEN value <> 0 THEN value END) AS median FROM prof GROUP BY ALL),
q AS (SELECT fov, peak, t, label, any_value(height) AS height, any_value(median) AS median, any_value(m) - 3 AS location, sum(greatest(value - median, 0)) AS s,
  sum(greatest(value - median, 0)*pos) AS sx, sum(greatest(value - median, 0)*pos*pos) AS sxx FROM prof JOIN tp USING (fov, peak, t, label) GROUP BY fov, peak, t, label) ----
SELECT fov, peak, t, label, location, height, median, CASE WHEN s > 0 THEN sqrt(greatest(sxx/s - sx/s*(sx/s), 0)) END AS width FROM q""", uses="regions")
def _(d):
    return p.ring(_profile(d))


@query("p10_cross_profiles", REG + "place:s pos:l value:d", f"""{_AXIS},
pl AS (SELECT 'mid' AS place, 0.0E0 AS s UNION ALL SELECT 'quarter1', -0.25E0 UNION ALL SELECT 'quarter2', 0.25E0),
img AS (SELECT p.fov, p.peak, p.t, r.label, p.v, r.major AS len, r.minor + 1 AS wid,
  round(((p.x - r.x)*cos(r.orientation) - (p.y - r.y)*sin(r.orientation))*CASE WHEN r.orientation > 0 THEN -1 ELSE 1 END, 9) AS u,
  round(((p.x - r.x)*sin(r.orientation) + (p.y - r.y)*cos(r.orientation))*CASE WHEN sin(r.orientation) < 0 THEN -1 ELSE 1 END, 9) AS w
  FROM pixels p JOIN regions r USING (fov, peak, t)),
cv AS (SELECT fov, peak, t, label, place, round_even(w, 0) AS k, avg(v) AS value FROM img, pl WHERE round(abs(u - len*s), 9) <= 3 AND abs(w) <= round((wid + 8)/2, 9) GROUP BY ALL) ----
SELECT r.fov, r.peak, r.t, r.label, pl.place, hs.k + floor(round((r.minor + 9)/2, 9)) AS pos, coalesce(cv.value, 0) AS value FROM regions r JOIN pl ON true
JOIN hs ON abs(hs.k) <= floor(round((r.minor + 9)/2, 9))
LEFT JOIN cv ON cv.fov = r.fov AND cv.peak = r.peak AND cv.t = r.t AND cv.label = r.label AND cv.place = pl.place AND cv.k = hs.k""", uses="regions")
def _(d):
    return p.cross_profiles(d.stacks, _obs(d))


@query("p11_constriction_time", "cell_id:l constriction_time:l", f"""{_AXIS},
ah AS (SELECT *, round_even(round(wid/2, 9), 0) + 3 AS h FROM ax),
bn AS (SELECT fov, peak, t, label, round(sum(v*(power(greatest(least(round_even(u, 0), h), -h), 2) - h*(h + 1)/3)), 6) AS b FROM ah
  WHERE abs(u) <= h + 0.5 AND abs(w) <= h + 0.5 GROUP BY ALL) ----
SELECT r.fov*1000 + r.peak*10 + r.label AS cell_id, coalesce(max(CASE WHEN b < 0 THEN r.t END), max(r.t)) AS constriction_time
FROM regions r LEFT JOIN bn USING (fov, peak, t, label) GROUP BY 1""", uses="regions")
def _(d):
    obs = _obs(d).withColumn("cell_id", F.col("fov") * 1000 + F.col("peak") * 10 + F.col("label"))
    return p.constriction_time(d.stacks, d.label_images, obs)


_ENS = """ml AS (SELECT o.cell_id, o.t, c.sb*exp(ln(c.sd/c.sb)/c.tau*(o.t - min(o.t) OVER (PARTITION BY o.cell_id))*3) AS l FROM cell_obs o JOIN cells c USING (cell_id)),
bp AS (SELECT m.cell_id, m.t, CAST(round_even(round(m.l*10, 9), 0) AS INT) AS size_bin, p.profile FROM ml m JOIN profiles p USING (cell_id) WHERE m.t % 2 = 1 OR m.t = 1),
kp AS (SELECT *, CAST(round_even(size_bin/10.0E0/0.11E0, 0) AS INT) AS n FROM bp),
sl AS (SELECT cell_id, t, size_bin, list_slice(profile, CAST((greatest(64 - n, 0)) // 2 + 1 AS BIGINT), CAST((greatest(64 - n, 0)) // 2 + least(n, 64) AS BIGINT)) AS pr FROM kp),
nb AS (SELECT size_bin, count(*) AS n FROM sl GROUP BY size_bin HAVING count(*) > 8),
mean_ AS (SELECT s.size_bin, r.i - 1 - any_value(len(s.pr)) // 2 AS pos, sum(CAST(s.pr[r.i] AS DOUBLE))/any_value(nb.n) AS value, any_value(nb.n) AS n
  FROM sl s JOIN nb USING (size_bin) JOIN (SELECT unnest(range(1, 65)) AS i) r ON r.i <= len(s.pr) GROUP BY s.size_bin, r.i),
bins AS (SELECT size_bin, any_value(n) AS n, sum(value) AS fl_sum, max(value) AS fl_max, sum(value*value*value*value) AS fl_amp,
  (size_bin/10.0E0 - (SELECT avg(width) FROM cells))*pi()*power((SELECT avg(width) FROM cells)/2, 2) + 4/3.0E0*pi()*power((SELECT avg(width) FROM cells)/2, 3) AS volume
  FROM mean_ GROUP BY size_bin)"""
OPTS = dict(px2um=0.11, time_int=3, fl_int=2, fl_start=1, cell_min=8)


def _cell_profiles(d):
    return d.profiles.join(d.obs.select("cell_id", "t"), "cell_id").select("cell_id", "t", "profile")


@query("p12_ensemble_profiles", "size_bin:l pos:l value:d n:l", f"{_ENS} ---- SELECT * FROM mean_", uses="cells cell_obs profiles")
def _(d):
    return p.ensemble_profiles(d.cells, d.obs, _cell_profiles(d), **OPTS)


@query("p12_size_ensemble", "size_bin:l n:l fl_sum:d fl_max:d fl_amp:d volume:d foci_avg:d foci_diff:d", f"""{_ENS},
fc AS (SELECT cell_id, t + focus_label % 2 AS t, count(*) AS k FROM focus_obs GROUP BY cell_id, t + focus_label % 2),
fa AS (SELECT b.*, q.k/CAST(b.n AS DOUBLE) AS foci_avg FROM bins b JOIN (SELECT size_bin, sum(coalesce(k, 0)) AS k FROM sl LEFT JOIN fc USING (cell_id, t) GROUP BY size_bin) q USING (size_bin)) ----
SELECT *, CASE WHEN (row_number() OVER (ORDER BY size_bin) - 1) % 2 = 0 THEN lead(foci_avg, 2) OVER (ORDER BY size_bin) - foci_avg END AS foci_diff FROM fa""",
       uses="cells cell_obs profiles focus_obs")
def _(d):
    # foci of some labels lie a frame later, so that frames have none, one or two
    foci = d.foci_of(d.obs).withColumn("t", F.col("t") + F.col("focus_label") % 2)
    return p.size_ensemble(d.cells, d.obs, _cell_profiles(d), foci, **OPTS)


@query("p13_nucleoid_ensemble", "size_bin:l n:l fl_sum:d fl_max:d fl_amp:d volume:d", f"{_ENS} ---- SELECT * FROM bins", uses="cells cell_obs profiles")
def _(d):
    return p.nucleoid_ensemble(d.cells, d.obs, _cell_profiles(d), **OPTS)


@query("p14_trace_points", "fov:l peak:l cell_id:l part:s hours:d y:d value:d scaled:d", """
pp AS (SELECT o.cell_id, o.t, r.i - 1 AS i, CAST(p.profile[r.i] AS DOUBLE) AS v FROM profiles p JOIN cell_obs o USING (cell_id) JOIN (SELECT unnest(range(1, 65)) AS i) r ON true),
lim AS (SELECT min(v) AS a, max(v) AS b FROM pp),
u AS (SELECT cell_id, 'profile' AS part, t*3/60.0E0 AS hours, (i - 3)*0.11E0 AS y, v AS value, (v - a)/(b - a) AS scaled FROM pp, lim
UNION ALL SELECT o.cell_id, 'focus', o.t*3/60.0E0, (f.disp_l + o.length/2)*0.11E0, f.foci_h, NULL FROM focus_obs f JOIN cell_obs o USING (cell_id, t)
UNION ALL SELECT cell_id, 'concentration', t*3/60.0E0, NULL, fl_total/((length - width)*pi()*width*width/4 + pi()/6*width*width*width), NULL FROM cell_obs) ----
SELECT c.fov, c.peak, u.* FROM u JOIN cells c USING (cell_id)""", uses="cells cell_obs profiles focus_obs")
def _(d):
    return p.trace_points(d.cells, d.obs, _cell_profiles(d), d.foci_of(d.obs), time_int=3, px2um=0.11)
