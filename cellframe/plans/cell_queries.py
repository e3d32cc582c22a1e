"""Cell and observation tables."""

from pyspark.sql import functions as F

from ..functions.expr import volume, volume_alt
from ..operators import cells as c
from .registry import query

_FIRST = "first AS (SELECT cell_id, min(t) AS t, arg_min(length, t) AS l, arg_min(width, t) AS w, " \
         "arg_min(seconds, t) AS s FROM cell_obs GROUP BY cell_id)"
_WDIV = _FIRST + """, wdiv AS (
SELECT cell_id, t, seconds, length, width FROM cell_obs
UNION ALL
SELECT c.cell_id, a.t, a.s, a.l + b.l, (a.w + b.w)/2 FROM cells c JOIN first a ON a.cell_id = c.child1_id
  JOIN first b ON b.cell_id = c.child2_id WHERE c.cell_id IN (SELECT cell_id FROM cell_obs))"""
_VOL = "(({l} - {w})*pi()*({w}/2)*({w}/2) + 4/3.0E0*pi()*({w}/2)*({w}/2)*({w}/2))"
OBS = "cells cell_obs"


def wdiv(d):
    return d.by_cell(c.obs_with_division(d.cells, d.obs))


@query("c1_order_daughters", "parent_id:l child1_id:l child2_id:l", _FIRST + """ ---- 
SELECT parent_id, arg_min(cell_id, k) AS child1_id, CASE WHEN count(*) > 1 THEN arg_max(cell_id, k) END AS child2_id
FROM (SELECT c.parent_id, c.cell_id, row_number() OVER (PARTITION BY c.parent_id ORDER BY f.l, c.cell_id) AS k
  FROM cells c JOIN first f USING (cell_id) WHERE c.parent_id IS NOT NULL) r GROUP BY parent_id""", uses=OBS)
def _(d):
    return c.order_daughters(d.cells, d.cell_obs, y="length")


@query("c2_division_summary", "cell_id:l sb:d sd:d delta:d tau:d division_time:l septum_position:d width:d",
       _FIRST + """ ----
SELECT c.cell_id, f.l*0.11E0 AS sb, (a.l + b.l)*0.11E0 AS sd, (a.l + b.l)*0.11E0 - f.l*0.11E0 AS delta,
  (a.s - f.s)/60.0E0 AS tau, a.t AS division_time, a.l/(a.l + b.l) AS septum_position,
  ((SELECT sum(width) FROM cell_obs o WHERE o.cell_id = c.cell_id) + (a.w + b.w)/2)
   /((SELECT count(*) FROM cell_obs o WHERE o.cell_id = c.cell_id) + 1)*0.11E0 AS width
FROM cells c JOIN first f ON f.cell_id = c.cell_id JOIN first a ON a.cell_id = c.child1_id
JOIN first b ON b.cell_id = c.child2_id""", uses=OBS)
def _(d):
    return c.division_summary(d.cells, d.obs, px2um=0.11)


@query("c3_obs_with_division", "cell_id:l t:l seconds:l length:d width:d volume:d", _WDIV + f""" ----
SELECT *, {_VOL.format(l='length', w='width')} AS volume FROM wdiv""", uses=OBS)
def _(d):
    return wdiv(d)


@query("c4_elongation_rate", "cell_id:l elong_rate:d", _WDIV + """ ----
SELECT cell_id, CASE WHEN count(DISTINCT seconds) > 1 THEN regr_slope(ln(length), seconds/60.0E0)*60 END AS elong_rate
FROM wdiv GROUP BY cell_id""", uses=OBS)
def _(d):
    return c.elongation_rate(wdiv(d))


@query("c5_growth_rate_minute", "cell_id:l growth_rate:d growth_rate_intercept:d", """
SELECT cell_id, CASE WHEN count(*) > 1 THEN regr_slope(y, x) END AS growth_rate,
  CASE WHEN count(*) > 1 THEN regr_intercept(y, x) END AS growth_rate_intercept
FROM (SELECT cell_id, ln(length) AS y, (t - min(t) OVER (PARTITION BY cell_id))*3.0E0 AS x FROM cell_obs) o
GROUP BY cell_id""", uses=OBS)
def _(d):
    return c.growth_rate(d.cell_obs, mpf=3)


@query("c6_log_linear_fit", "cell_id:l t:l length:d length_fit:d r2:d", _WDIV + """ ----
SELECT w.cell_id, w.t, w.length, exp(f.a*(w.t - f.t0) + f.b) AS length_fit, f.r2
FROM wdiv w JOIN (SELECT cell_id, min(t) AS t0, regr_slope(y, x) AS a, regr_intercept(y, x) AS b,
    CASE WHEN max(y) - min(y) < 1e-9 THEN 0 ELSE corr(y, x)*corr(y, x) END AS r2
  FROM (SELECT cell_id, t, ln(length) AS y, t - min(t) OVER (PARTITION BY cell_id) AS x FROM wdiv) z
  GROUP BY cell_id HAVING count(DISTINCT t) > 1) f USING (cell_id)""", uses=OBS)
def _(d):
    return c.log_fit(wdiv(d))


@query("c7_coefficient_of_determination", "cell_id:l r2:d", """
SELECT cell_id, CASE WHEN var_pop(length) > 0 THEN
  1 - sum((length - fit)*(length - fit))/(var_pop(length)*count(*)) END AS r2
FROM (SELECT o.cell_id, o.length, c.sb*exp(c.elong_rate/60*(o.t - c.birth_time)) AS fit
  FROM cell_obs o JOIN cells c USING (cell_id)) x GROUP BY cell_id""", uses=OBS)
def _(d):
    born = d.cells.select("cell_id", "sb", "elong_rate", "birth_time")
    model = F.col("sb") * F.exp(F.col("elong_rate") / 60 * (F.col("t") - F.col("birth_time")))
    return c.r2(d.cell_obs.join(born, "cell_id").withColumn("fit", model), y="length", yfit="fit", by=["cell_id"])


@query("c8_breakpoint_guess", "cell_id:l x_mid:d y_mid:d slope1:d slope2:d", _WDIV + """ ----
SELECT cell_id, xm - x0 AS x_mid, ym AS y_mid, CASE WHEN xm = x0 THEN 0 ELSE (ym - y0)/(xm - x0) END AS slope1,
  CASE WHEN xm = xn THEN 0 ELSE (yn - ym)/(xn - xm) END AS slope2
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round((y - y0) - (yn - y0)/(xn - x0)*(xm - x0), 12), xm) AS k
  FROM (SELECT cell_id, CAST(t AS DOUBLE) AS xm, ln(length) AS ym, ln(length) AS y,
      CAST(min(t) OVER w AS DOUBLE) AS x0, CAST(max(t) OVER w AS DOUBLE) AS xn,
      first_value(ln(length)) OVER (w ORDER BY t) AS y0, first_value(ln(length)) OVER (w ORDER BY t DESC) AS yn
    FROM wdiv WINDOW w AS (PARTITION BY cell_id)) a WHERE xn > x0) b WHERE k = 1""", uses=OBS)
def _(d):
    return c.breakpoint_guess(wdiv(d))


@query("c9_bilinear_fit", "cell_id:l t_shift:l length_at_shift:d slope1:d slope2:d r2:d", _WDIV + """,
pts AS (SELECT cell_id, t, ln(length) AS y FROM wdiv),
m AS (SELECT k.cell_id, k.t, count(*) AS n, sum(p.y) AS sy, sum(p.y*p.y) AS syy, CASE WHEN max(p.y) - min(p.y) >= 1e-9 THEN var_pop(p.y) END AS vy,
  sum(least(p.t - k.t, 0)) AS su, sum(least(p.t - k.t, 0)*least(p.t - k.t, 0)) AS suu, sum(least(p.t - k.t, 0)*p.y) AS suy,
  sum(greatest(p.t - k.t, 0)) AS sw, sum(greatest(p.t - k.t, 0)*greatest(p.t - k.t, 0)) AS sww,
  sum(greatest(p.t - k.t, 0)*p.y) AS swy
  FROM pts k JOIN pts p ON p.cell_id = k.cell_id GROUP BY k.cell_id, k.t),
a AS (SELECT *, (sy - CASE WHEN suu > 0 THEN su*suy/suu ELSE 0 END - CASE WHEN sww > 0 THEN sw*swy/sww ELSE 0 END)
  /(n - CASE WHEN suu > 0 THEN su*su/CAST(suu AS DOUBLE) ELSE 0 END - CASE WHEN sww > 0 THEN sw*sw/CAST(sww AS DOUBLE) ELSE 0 END) AS a
  FROM m WHERE n > 1),
b AS (SELECT *, CASE WHEN suu > 0 THEN (suy - a*su)/suu ELSE 0 END AS b, CASE WHEN sww > 0 THEN (swy - a*sw)/sww ELSE 0 END AS c FROM a),
e AS (SELECT *, round(syy - a*sy - b*suy - c*swy, 9) AS sse FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY sse, t) AS k FROM e) ----
SELECT cell_id, t AS t_shift, exp(a) AS length_at_shift, b AS slope1, c AS slope2,
  CASE WHEN vy > 0 THEN 1 - sse/(vy*n) END AS r2 FROM f WHERE k = 1""", uses=OBS)
def _(d):
    return c.bilinear_fit(wdiv(d))


@query("c10_wide_cells", "id:l parent_id:s child1_id:s child2_id:s fov:l peak:l sb:d sd:d death:l disappear:l", """
SELECT cell_id AS id, coalesce(CAST(parent_id AS VARCHAR), '') AS parent_id, child1_id, child2_id, fov, peak, sb, sd,
  death, NULL AS disappear FROM cells""", uses="cells")
def _(d):
    return c.wide_cells(d.cells)


@query("c11_long_cells", "cell_id:l t:l length:d width:d fl_c2:d fl_c3:d",
       "SELECT cell_id, t, length, width, fl_total AS fl_c2, area AS fl_c3 FROM cell_obs", uses=OBS)
def _(d):
    o = d.cell_obs
    fl = o.select("cell_id", "t", F.lit("c2").alias("plane"), F.col("fl_total").alias("total")).unionByName(
        o.select("cell_id", "t", F.lit("c3").alias("plane"), F.col("area").alias("total")))
    return c.long_cells(o, fl, planes=["c2", "c3"])


@query("c12_cells_frame", "cell_id:l fov:l birth_label:l sb:d sd:d width:d delta:d tau:d elong_rate:d septum_position:d", """
SELECT cell_id, fov, birth_label, sb/(SELECT avg(sb) FROM cells) AS sb, sd/(SELECT avg(sd) FROM cells) AS sd,
  width/(SELECT avg(width) FROM cells) AS width, delta/(SELECT avg(delta) FROM cells) AS delta,
  tau/(SELECT avg(tau) FROM cells) AS tau, elong_rate/(SELECT avg(elong_rate) FROM cells) AS elong_rate,
  septum_position/(SELECT avg(septum_position) FROM cells) AS septum_position FROM cells""", uses="cells")
def _(d):
    return c.cells_frame(d.cells, rescale_means=True, keep=["cell_id"])


@query("c13_cycle_frame", "cell_id:l sb:d initiation_time:l termination_time:l birth_volume:d division_volume:d", f"""
SELECT cell_id, sb, initiation_time, termination_time, {_VOL.format(l='sb', w='width')} AS birth_volume,
  {_VOL.format(l='sd', w='width')} AS division_volume FROM cells JOIN cell_cycle USING (cell_id)""",
       uses="cells cell_cycle")
def _(d):
    return c.cycle_frame(d.cells, d.cell_cycle)


@query("c14_mid_time", "cell_id:l mid_time:d",
       "SELECT cell_id, (birth_time + division_time)/2.0E0 AS mid_time FROM cells", uses="cells")
def _(d):
    return c.mid_time(d.cells)


@query("c15_cell_foci", "cell_id:l focus_label:l", "SELECT DISTINCT cell_id, focus_label FROM focus_obs", uses="focus_obs")
def _(d):
    return c.cell_foci(d.cells, d.focus_obs, focus="focus_label")


@query("r3_volume", "cell_id:l t:l volume:d",
       f"SELECT cell_id, t, {_VOL.format(l='length', w='width')} AS volume FROM cell_obs", uses=OBS)
def _(d):
    return d.cell_obs.withColumn("volume", volume("length", "width"))


@query("r4_volume_alternative", "cell_id:l t:l volume:d", """
SELECT cell_id, t, pi()/4*width*width*length - pi()/12*width*width*width AS volume FROM cell_obs""", uses=OBS)
def _(d):
    return d.cell_obs.withColumn("volume", volume_alt("length", "width"))
