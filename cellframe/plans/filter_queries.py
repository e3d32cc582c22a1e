"""Filters on cells and observations."""

from pyspark.sql import functions as F

from ..operators import filters as f
from .registry import query

CELL = "cell_id:l fov:l peak:l birth_label:l birth_time:l division_time:l sb:d sd:d"
CUT = "lo:d hi:d"


@query("f1_complete_cells", CELL,
       "SELECT * FROM cells WHERE parent_id IS NOT NULL AND child1_id IS NOT NULL", uses="cells")
def _(d):
    return f.complete(d.cells)


@query("f2_mother_cells", CELL, "SELECT * FROM cells WHERE birth_label = 1", uses="cells")
def _(d):
    return f.mothers(d.cells)


@query("f3_birth_labels", CELL, "SELECT * FROM cells WHERE birth_label IN (1, 2)", uses="cells")
def _(d):
    return f.by_birth_label(d.cells, labels=(1, 2))


@query("f4_fovs", CELL, "SELECT * FROM cells WHERE fov IN (1, 3)", uses="cells")
def _(d):
    return f.by_fov(d.cells, fovs=(1, 3))


@query("f5_fov_and_peak", CELL, "SELECT * FROM cells WHERE fov = 2 AND peak = 4", uses="cells")
def _(d):
    return f.by_fov_peak(d.cells, fov=2, peak=4)


@query("f6_fov_peak_map", CELL,
       "SELECT * FROM cells WHERE fov = 1 OR (fov = 2 AND peak IN (3, 5))", uses="cells")
def _(d):
    return f.by_fov_peaks(d.cells, mapping={1: None, 2: [3, 5]})


@query("f7_born_between", CELL, "SELECT * FROM cells WHERE birth_time BETWEEN 40 AND 100", uses="cells")
def _(d):
    return f.born_before(f.born_after(d.cells, t=40), t=100)


@query("f8_attribute_equals", CELL, "SELECT * FROM cells WHERE tau = 25", uses="cells")
def _(d):
    return f.where_attr(d.cells, attr="tau", val=25.0)


@query("f8_list_item_equals", CELL, "SELECT * FROM cells WHERE child2_id = 602", uses="cells")
def _(d):
    both = d.cells.withColumn("daughters", F.array("child1_id", "child2_id"))
    return f.where_attr(both, attr="daughters", val=602, idx=1)


@query("f9_list_contains", CELL,
       "SELECT * FROM cells c WHERE EXISTS (SELECT 1 FROM cell_obs o WHERE o.cell_id = c.cell_id AND o.t = 123)",
       uses="cells cell_obs")
def _(d):
    return f.where_contains(d.cells, d.cell_obs, attr="t", val=123)


@query("f10_foci_with_label_at_time", "cell_id:l t:l label:l disp_l:d", """
SELECT cell_id, t, focus_label AS label, disp_l FROM focus_obs WHERE cell_id IN
  (SELECT cell_id FROM focus_obs WHERE focus_label = 2 AND t = 125)""", uses="focus_obs")
def _(d):
    return f.foci_at(d.focus_obs.withColumnRenamed("focus_label", "label"), label=2, t=125, key="cell_id")


_WITHIN = " AND ".join(
    f"{c} > (SELECT {{m}}({c}) - 1.5*stddev_samp({c}) FROM cells) AND "
    f"{c} < (SELECT {{m}}({c}) + 1.5*stddev_samp({c}) FROM cells)"
    for c in ("sb", "sd", "delta", "elong_rate", "tau", "septum_position"))


@query("f11_filter_by_stat", CELL, f"SELECT * FROM cells WHERE {_WITHIN.format(m='avg')}", uses="cells")
def _(d):
    return f.filter_by_stat(d.cells, k=1.5)


@query("f11_filter_by_stat_median", CELL, f"SELECT * FROM cells WHERE {_WITHIN.format(m='median')}", uses="cells")
def _(d):
    return f.filter_by_stat(d.cells, center="50%", k=1.5)


@query("f12_cutoffs_mean", CUT,
       "SELECT avg(sd) - 2*stddev_pop(sd) AS lo, avg(sd) + 1.5*stddev_pop(sd) AS hi FROM cells", uses="cells")
def _(d):
    return f.cutoffs(d.cells, col="sd", method="mean", plo=2, phi=1.5)


@query("f12_cutoffs_median", CUT, """
SELECT m - 0.5*(b - a) AS lo, m + (b - a) AS hi FROM (SELECT quantile_cont(sb, 0.25) AS a,
  quantile_cont(sb, 0.5) AS m, quantile_cont(sb, 0.75) AS b FROM cells) q""", uses="cells")
def _(d):
    return f.cutoffs(d.cells, col="sb", method="median", plo=0.5, phi=1)


@query("f12_cutoffs_median_min", CUT, """
SELECT m + 0.5*(SELECT median(abs(c.sb - q.m)) FROM cells c) AS lo, NULL AS hi
FROM (SELECT median(sb) AS m FROM cells) q""", uses="cells")
def _(d):
    return f.cutoffs(d.cells, col="sb", method="median-min", plo=0.5)


@query("f12_cutoffs_logmean", CUT, """
SELECT exp(avg(ln(sb)) - stddev_pop(ln(sb))) AS lo, exp(avg(ln(sb)) + 2*stddev_pop(ln(sb))) AS hi
FROM cells WHERE sb > 0""", uses="cells")
def _(d):
    return f.cutoffs(d.cells, col="sb", method="logmean", plo=1, phi=2)


@query("f13_filter_by_cutoffs", CELL, """
SELECT * FROM cells WHERE sb >= (SELECT avg(sb) - stddev_pop(sb) FROM cells)
  AND sb <= (SELECT avg(sb) + 1.5*stddev_pop(sb) FROM cells)
  AND tau >= 22 AND tau <= 29
  AND sd >= (SELECT median(sd) - 0.7*(quantile_cont(sd, 0.75) - quantile_cont(sd, 0.25)) FROM cells)
  AND sd <= (SELECT median(sd) + 0.7*(quantile_cont(sd, 0.75) - quantile_cont(sd, 0.25)) FROM cells)""",
       uses="cells")
def _(d):
    return f.filter_by_cutoffs(d.cells, spec={
        "sb": {"method": "mean", "plo": 1, "phi": 1.5}, "tau": {"xlo": 22, "xhi": 29},
        "sd": {"method": "median", "plo": 0.7, "phi": 0.7}})


@query("f13_cutoff_summary", "name:s median:d iqr:d std:d", " UNION ALL ".join(
    f"SELECT '{c}' AS name, median({c}) AS median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, "
    f"stddev_pop({c}) AS std FROM cells" for c in ("sb", "sd", "tau")), uses="cells")
def _(d):
    return f.cutoff_summary(d.cells, cols=["sb", "sd", "tau"])


@query("f14_has_cell_cycle", "cell_id:l initiation_time:l termination_time:l", """
SELECT * FROM (SELECT cell_id, initiation_time, termination_time FROM cell_cycle) c
WHERE initiation_time IS NOT NULL AND termination_time IS NOT NULL""", uses="cell_cycle")
def _(d):
    return f.has_cycle(d.cell_cycle)


@query("f15_channels_to_analyse", CELL, """
SELECT c.* FROM cells c JOIN specs s ON s.fov = c.fov AND s.peak = c.peak WHERE s.spec = 1""", uses="cells specs")
def _(d):
    return f.analysed(d.cells, d.specs)


@query("f15_empty_channels", CELL, """
SELECT c.* FROM cells c JOIN specs s ON s.fov = c.fov AND s.peak = c.peak WHERE s.spec = 0""", uses="cells specs")
def _(d):
    return f.analysed(d.cells, d.specs, spec=0)


@query("f16_complete_pairs", "cell_id:l parent_id:l sb:d",
       "SELECT * FROM cells WHERE parent_id IS NOT NULL AND sb IS NOT NULL", uses="cells")
def _(d):
    return f.pairs(d.cells, x="parent_id", y="sb")


@query("f17_fluorescence_frames", "cell_id:l t:l fl_total:d",
       "SELECT * FROM cell_obs WHERE t % 3 = 1 OR t = 1", uses="cell_obs")
def _(d):
    return f.fl_frames(d.cell_obs, start=1, every=3)


@query("f17_even_frames", "cell_id:l t:l fl_total:d", "SELECT * FROM cell_obs WHERE t % 2 = 0", uses="cell_obs")
def _(d):
    return f.fl_frames(d.cell_obs, start=0, every=2)
