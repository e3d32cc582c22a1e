"""Population statistics."""

from pyspark.sql import functions as F

from ..functions.ordered import union_all
from ..operators import filters as f
from ..operators import stats as s
from ..operators.cells import obs_with_division, rescale
from .registry import query

COLS = ("sb", "sd", "width", "delta", "tau", "elong_rate", "septum_position")
_STAT = "avg({c}) AS mean, stddev_samp({c}) AS std, stddev_samp({c})/avg({c}) AS cv, median({c}) AS median, min({c}) AS min, max({c}) AS max"
_IN3 = " AND ".join(f"{c} > avg({c}) OVER () - 3*stddev_samp({c}) OVER () AND {c} < avg({c}) OVER () + 3*stddev_samp({c}) OVER ()"
                    for c in ("sb", "sd", "delta", "elong_rate", "tau", "septum_position"))


@query("a1_stats_table", "name:s mean:d std:d cv:d median:d min:d max:d", f"""
k AS (SELECT * FROM cells WHERE parent_id IS NOT NULL AND child1_id IS NOT NULL AND birth_label IN (1, 2)
  QUALIFY {_IN3}) ---- """ + " UNION ALL ".join(f"SELECT '{c}' AS name, {_STAT.format(c=c)} FROM k" for c in COLS), uses="cells")
def _(d):
    return s.stats_table(f.filter_by_stat(f.by_birth_label(f.complete(d.cells), labels=(1, 2)), k=3))


@query("a1_stats_table_all_cells", "name:s mean:d std:d cv:d median:d min:d max:d",
       " UNION ALL ".join(f"SELECT '{c}' AS name, {_STAT.format(c=c)} FROM cells" for c in COLS), uses="cells")
def _(d):
    return s.stats_table(d.cells)


_G = "count({c}) AS n, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, median({c}) AS median, quantile_cont({c}, 0.75) AS q75, " \
     "max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std"
GROUPED = "name:s n:l min:d q25:d median:d q75:d max:d mean:d std:d"


@query("a2_stats_by_fov", "fov:l " + GROUPED, " UNION ALL ".join(
    f"SELECT fov, '{c}' AS name, {_G.format(c=c)} FROM cells GROUP BY fov" for c in ("sb", "elong_rate")), uses="cells")
def _(d):
    return s.group_stats(d.cells, by=["fov"], cols=["sb", "elong_rate"])


@query("a2_stats_by_birth_label", "birth_label:l " + GROUPED, " UNION ALL ".join(
    f"SELECT birth_label, '{c}' AS name, {_G.format(c=c)} FROM cells GROUP BY birth_label" for c in ("sb", "tau")), uses="cells")
def _(d):
    return s.group_stats(d.cells, by=["birth_label"], cols=["sb", "tau"])


def _bins_sql(table, col):
    """CTEs m (mean range) and bins (lo, w, n) by Sturges' rule."""
    return f"""m AS (SELECT avg({col}) - 3*stddev_samp({col}) AS lo, avg({col}) + 3*stddev_samp({col}) AS hi FROM {table}),
bins AS (SELECT lo, hi, (hi - lo)/n AS w, n FROM (SELECT any_value(m.lo) AS lo, any_value(m.hi) AS hi,
  CAST(ceil((any_value(m.hi) - any_value(m.lo))/((max({col}) - min({col}))/(log2(count(*)) + 1))) AS INT) AS n
  FROM {table}, m WHERE {col} BETWEEN m.lo AND m.hi) q)"""


def _hist_sql(table, col):
    return f"""cnt AS (SELECT i, count(*) AS c FROM (SELECT CASE WHEN {col} = b.lo + b.w*b.n THEN b.n - 1 ELSE floor(({col} - b.lo)/b.w) END AS i
  FROM {table}, bins b) q, bins b WHERE i >= 0 AND i < b.n GROUP BY i),
h AS (SELECT b.lo + r.i*b.w AS l, b.lo + r.i*b.w + b.w AS r, b.lo + r.i*b.w + b.w/2 AS x,
  coalesce(cnt.c, 0)/((SELECT sum(c) FROM cnt)*b.w) AS density
  FROM bins b, (SELECT unnest(range(0, 100000)) AS i) r LEFT JOIN cnt ON cnt.i = r.i WHERE r.i < b.n)"""


@query("a3_sturges_edges", "bin:l left:d right:d", _bins_sql("cells", "sd") + """ ----
SELECT r.i AS bin, lo + r.i*w AS "left", lo + r.i*w + w AS "right" FROM bins, (SELECT unnest(range(0, 1000)) AS i) r WHERE r.i < n""",
       uses="cells")
def _(d):
    return s.bin_table(d.cells, s.sturges_bins(d.cells, col="sd"))


_LINE = "SELECT x, density FROM h UNION ALL SELECT min(l), 0 FROM h UNION ALL SELECT max(r), 0 FROM h"


@query("a4_histogram_line", "x:d density:d", f"{_bins_sql('cells', 'sd')}, {_hist_sql('cells', 'sd')} ---- {_LINE}", uses="cells")
def _(d):
    return s.histogram(d.cells, col="sd")


@query("a4_histogram_step_even_bins", "left:d right:d density:d", f"""
bins AS (SELECT min(delta) AS lo, (max(delta) - min(delta))/20 AS w, 20 AS n FROM cells), {_hist_sql('cells', 'delta')} ----
SELECT l AS "left", r AS "right", density FROM h""", uses="cells")
def _(d):
    return s.histogram(d.cells, col="delta", bins=20, kind="step")


@query("a4_histogram_tau_intervals", "x:d density:d", f"""
bins AS (SELECT 1.5E0 AS lo, 3.0E0 AS w, CAST(ceil(max(tau)/3.0E0) - 1 AS INT) AS n FROM cells), {_hist_sql('cells', 'tau')} ---- {_LINE}""",
       uses="cells")
def _(d):
    return s.histogram(d.cells, col="tau", bins=s.interval_bins(d.cells, col="tau", interval=3))


@query("a4_histogram_rescaled", "x:d density:d", f"""
z AS (SELECT sb/(SELECT avg(sb) FROM cells) AS v FROM cells),
bins AS (SELECT 0.0E0 AS lo, 2.0E0/n AS w, n FROM (SELECT CAST(ceil(2.0E0/((max(v) - min(v))/(log2(count(*)) + 1))) AS INT) AS n
  FROM z WHERE v BETWEEN 0 AND 2) q), {_hist_sql('z', 'v')} ---- {_LINE}""", uses="cells")
def _(d):
    return s.histogram(d.cells, col="sb", rescale_mean=True)


@query("a4_histogram_by_experiment", "exp:s x:d density:d", "\n".join([
    f"a AS (SELECT sd FROM cells WHERE fov <= 3), b AS (SELECT sd FROM cells WHERE fov > 3),",
    ", ".join(f"{_bins_sql(t, 'sd')}, {_hist_sql(t, 'sd')}".replace("m AS", f"m{t} AS").replace("bins", f"bins{t}")
              .replace("cnt", f"cnt{t}").replace("h AS (", f"h{t} AS (").replace(", m WHERE", f", m{t} m WHERE") for t in "ab"),
    " ---- " + " UNION ALL ".join(f"SELECT '{t}' AS exp, x, density FROM h{t} UNION ALL SELECT '{t}', min(l), 0 FROM h{t} "
                                  f"UNION ALL SELECT '{t}', max(r), 0 FROM h{t}" for t in "ab")]), uses="cells")
def _(d):
    parts = {"a": d.cells.where("fov <= 3"), "b": d.cells.where("fov > 3")}
    return union_all([s.histogram(p, col="sd").withColumn("exp", F.lit(n)) for n, p in parts.items()])


def _binned_sql(value, error="stddev_pop(y)/sqrt(count(*))"):
    return f"""st AS (SELECT i, {value} AS value, {error} AS error, count(*) AS n FROM (
  SELECT y, CASE WHEN x = b.lo + b.w*b.n THEN b.n - 1 ELSE floor((x - b.lo)/b.w) END AS i, b.n AS nb FROM z, bins b) q
  WHERE i >= 0 AND i < nb GROUP BY i)"""


_CENTRES = "(SELECT r.i, lo + r.i*w + w/2 AS center FROM bins, (SELECT unnest(range(0, 100000)) AS i) r WHERE r.i < n)"
BINNED = "center:d value:d error:d n:l"
_ZD = "z AS (SELECT sb AS x, delta AS y FROM cells)"


@query("a5_binned_mean", BINNED, f"{_ZD}, {_bins_sql('z', 'x')}, {_binned_sql('avg(y)')} ---- "
       f"SELECT c.center, st.value, st.error, coalesce(st.n, 0) AS n FROM {_CENTRES} c LEFT JOIN st ON st.i = c.i", uses="cells")
def _(d):
    return s.binned_stat(d.cells, x="sb", y="delta")


@query("a5_binned_median", BINNED, f"{_ZD}, {_bins_sql('z', 'x')}, {_binned_sql('median(y)', '1.253E0*stddev_pop(y)/sqrt(count(*))')} ---- "
       f"SELECT c.center, st.value, st.error, st.n FROM {_CENTRES} c JOIN st ON st.i = c.i WHERE st.n >= 10", uses="cells")
def _(d):
    return s.binned_stat(d.cells, x="sb", y="delta", stat="median", binmin=10)


_TREND = f"""z AS (SELECT birth_time*3/60.0E0 - (SELECT min(birth_time) FROM cells)*3/60.0E0 AS x, elong_rate AS y FROM cells),
bins AS (SELECT min(x) AS lo, 0.5E0 AS w, CAST(ceil((max(x) - min(x))/0.5E0) - 1 AS INT) AS n FROM z), {_binned_sql('avg(y)')}"""


@query("a6_time_trend", BINNED, f"{_TREND} ---- SELECT c.center, st.value, st.error, st.n FROM {_CENTRES} c JOIN st ON st.i = c.i WHERE st.n >= 10",
       uses="cells")
def _(d):
    return s.time_trend(d.cells, y="elong_rate", t_int=3, window=10)


@query("a7_trend_and_histogram", "part:s x:d value:d", f"{_TREND}".replace("bins", "tb").replace("st AS", "tst AS") + f""",
{_bins_sql('cells', 'elong_rate')}, {_hist_sql('cells', 'elong_rate')} ----
SELECT 'trend' AS part, c.center AS x, tst.value FROM {_CENTRES.replace('bins', 'tb')} c JOIN tst ON tst.i = c.i WHERE tst.n >= 10
UNION ALL SELECT 'histogram', x, density FROM ({_LINE}) l""", uses="cells")
def _(d):
    return s.trend_and_hist(d.cells, y="elong_rate", t_int=3, window=10)


@query("a8_trend_derivative", "center:d diff:d", f"""z AS (SELECT birth_time AS x, sd AS y FROM cells),
bins AS (SELECT min(x) - 1.0E0 AS lo, 10.0E0 AS w, CAST(ceil((max(x) - min(x) + 2)/10.0E0) - 1 AS INT) AS n FROM z), {_binned_sql('avg(y)')} ----
SELECT a.center, sb.value - sa.value AS diff FROM {_CENTRES} a JOIN {_CENTRES} b ON b.i = a.i + 1
LEFT JOIN st sa ON sa.i = a.i LEFT JOIN st sb ON sb.i = b.i""", uses="cells")
def _(d):
    return s.trend_derivative(d.cells, y="sd", window=10)


def _rate_sql(n, shift):
    return f"""p AS (SELECT cell_id, t, length, row_number() OVER (PARTITION BY cell_id ORDER BY t) AS i FROM cell_obs),
q AS (SELECT cell_id, t, length, lag(length) OVER (PARTITION BY cell_id ORDER BY t) AS l0 FROM p WHERE i % {n} = 1 % {n}),
r AS (SELECT t*3 - {shift} AS minutes, ln(length/l0)*60/{n}/3.0E0 AS rate FROM q WHERE l0 IS NOT NULL) ----
SELECT minutes, avg(rate) AS mean, stddev_pop(rate) AS std, stddev_pop(rate)/sqrt(count(*)) AS se, count(*) AS n FROM r GROUP BY minutes"""


@query("a9_instantaneous_rate", "minutes:d mean:d std:d se:d n:l", _rate_sql(1, 0), uses="cell_obs")
def _(d):
    return s.instant_rate(d.cell_obs, t_int=3)


@query("a9_instantaneous_rate_shifted", "minutes:d mean:d std:d se:d n:l", _rate_sql(2, 30), uses="cell_obs")
def _(d):
    return s.instant_rate(d.cell_obs, n=2, t_int=3, t_shift=10)


_REG = """SELECT slope, intercept, r, stderr, slope + 1.96E0*stderr AS slope_high, my - (slope + 1.96E0*stderr)*mx AS intercept_high,
  slope - 1.96E0*stderr AS slope_low, my - (slope - 1.96E0*stderr)*mx AS intercept_low, mx - 3*sx AS x_low, mx + 3*sx AS x_high, n
FROM (SELECT *, sqrt((1 - r*r)*vy/vx/(n - 2)) AS stderr FROM (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
  corr(y, x) AS r, var_pop(y) AS vy, var_pop(x) AS vx, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx FROM z) a) b"""
REG = "slope:d intercept:d r:d stderr:d slope_high:d intercept_high:d slope_low:d intercept_low:d x_low:d x_high:d n:l"


@query("a10_pair_correlation", REG, f"{_ZD} ---- {_REG}", uses="cells")
def _(d):
    return s.pair_corr(d.cells, x="sb", y="delta")


@query("a10_pair_correlation_rescaled", REG, f"""
z AS (SELECT sb/(SELECT avg(sb) FROM cells) AS x, sd/(SELECT avg(sd) FROM cells) AS y FROM cells) ---- {_REG}""", uses="cells")
def _(d):
    return s.pair_corr(d.cells, x="sb", y="sd", rescale_mean=True)


@query("a10_bin_regression", REG, f"z0 AS (SELECT sb AS x, sd AS y FROM cells), {_bins_sql('z0', 'x')}, "
       + _binned_sql('avg(y)').replace("FROM z,", "FROM z0,") +
       f", z AS (SELECT c.center AS x, st.value AS y FROM {_CENTRES} c JOIN st ON st.i = c.i WHERE st.n >= 5) ---- {_REG}", uses="cells")
def _(d):
    return s.bin_regression(d.cells, x="sb", y="sd", binmin=5)


_P = ("sb", "sd", "delta", "tau", "elong_rate")
_PAIRS = [(a, b) for i, a in enumerate(_P) for b in _P[i:]]


@query("a11_correlation_matrix", "x:s y:s r:d n:l", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) AS n FROM cells" for a, b in _PAIRS), uses="cells")
def _(d):
    return s.corr_matrix(d.cells, cols=_P)


@query("a11_rank_correlation_matrix", "x:s y:s r:d n:l", "k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0E0 AS {c}" for c in _P) + " FROM cells) ---- " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) AS n FROM k" for a, b in _PAIRS), uses="cells")
def _(d):
    return s.corr_matrix(d.cells, cols=_P, method="spearman")


@query("a12_correlation_list", "x:s y:s " + REG, " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, q.* FROM ({_REG.replace('FROM z)', f'FROM (SELECT {a} AS x, {b} AS y FROM cells) z)')}) q"
    for a, b in (("sb", "delta"), ("sb", "tau"), ("elong_rate", "tau"))), uses="cells")
def _(d):
    return s.corr_list(d.cells, pairs=[("sb", "delta"), ("sb", "tau"), ("elong_rate", "tau")])


@query("a13_hexbin", "hx:d hy:d n:l", """
e AS (SELECT lo - (hi - lo)*1e-9 AS l, hi + (hi - lo)*1e-9 AS r FROM (SELECT CAST(min(birth_time) AS DOUBLE) AS lo, CAST(max(birth_time) AS DOUBLE) AS hi FROM cells) q),
p AS (SELECT (birth_time - l)/((r - l)/20) AS ix, (sb - 0)/(4.0E0/10) AS iy, (r - l)/20 AS sx, l FROM cells, e),
k AS (SELECT *, round_even(ix, 0) AS ax, round_even(iy, 0) AS ay, floor(ix) AS bx, floor(iy) AS by_ FROM p),
g AS (SELECT *, (ix-ax)*(ix-ax) + 3*(iy-ay)*(iy-ay) < (ix-bx-0.5)*(ix-bx-0.5) + 3*(iy-by_-0.5)*(iy-by_-0.5) AS on_a FROM k),
c AS (SELECT CASE WHEN on_a THEN ax ELSE bx + 0.5 END AS i, CASE WHEN on_a THEN ay ELSE by_ + 0.5 END AS j, sx, l FROM g
  WHERE (on_a AND ax BETWEEN 0 AND 20 AND ay BETWEEN 0 AND 10) OR (NOT on_a AND bx >= 0 AND bx < 20 AND by_ >= 0 AND by_ < 10)) ----
SELECT i*any_value(sx) + any_value(l) AS hx, j*0.4E0 AS hy, count(*) AS n FROM c GROUP BY i, j HAVING count(*) >= 3""", uses="cells")
def _(d):
    e = d.cells.agg(F.min("birth_time"), F.max("birth_time")).first()
    return s.hexbin(d.cells, x="birth_time", y="sb", extent=(e[0], e[1], 0, 4))


@query("a14_sampled_traces", "cell_id:l hours:d length:d", """
SELECT cell_id, t*3/60.0E0 AS hours, length FROM cell_obs WHERE cell_id IN (
  SELECT cell_id FROM cells ORDER BY md5(concat(CAST(cell_id AS VARCHAR), ':7')), cell_id LIMIT 200)""", uses="cells cell_obs")
def _(d):
    return s.sample_traces(d.cells, d.cell_obs, n=200, seed=7, t_int=3)


@query("a15_saw_tooth", "fov:l peak:l cell_id:l part:s hours:d y:d max_sd:d", """
top AS (SELECT fov, peak, max(sd) AS max_sd FROM cells GROUP BY fov, peak),
first AS (SELECT cell_id, arg_min(length, t) AS l, arg_min(t, t) AS t FROM cell_obs GROUP BY cell_id),
wdiv AS (SELECT cell_id, t, length FROM cell_obs UNION ALL
  SELECT c.cell_id, a.t, a.l + b.l FROM cells c JOIN first a ON a.cell_id = c.child1_id JOIN first b ON b.cell_id = c.child2_id
  WHERE c.cell_id IN (SELECT cell_id FROM cell_obs)),
con AS (SELECT * FROM (SELECT *, lag(division_time) OVER w AS pd, lag(sd) OVER w AS psd FROM cells
  WINDOW w AS (PARTITION BY fov, peak ORDER BY birth_time, cell_id)) x WHERE pd = birth_time),
pts AS (SELECT c.fov, c.peak, c.cell_id, 'trace' AS part, w.t*3/60.0E0 AS hours, w.length AS y FROM wdiv w JOIN cells c USING (cell_id)
  UNION ALL SELECT fov, peak, cell_id, 'from', birth_time*3/60.0E0, psd FROM con
  UNION ALL SELECT fov, peak, cell_id, 'to', birth_time*3/60.0E0, sb FROM con) ----
SELECT p.*, t.max_sd FROM pts p JOIN top t USING (fov, peak)""", uses="cells cell_obs")
def _(d):
    return s.saw_tooth(d.cells, obs_with_division(d.cells, d.obs), t_int=3)


@query("a16_rescale", "cell_id:l sb:d tau:d", """
SELECT cell_id, sb/(SELECT avg(sb) FROM cells) AS sb, tau/(SELECT avg(tau) FROM cells) AS tau FROM cells""", uses="cells")
def _(d):
    return rescale(d.cells, cols=["sb", "tau"])


@query("a17_mean_and_error", "t:l mean:d std:d se:d n:l", """
SELECT t, avg(length) AS mean, stddev_pop(length) AS std, stddev_pop(length)/sqrt(count(length)) AS se, count(length) AS n
FROM cell_obs GROUP BY t""", uses="cell_obs")
def _(d):
    return s.mean_se(d.cell_obs, by=["t"], col="length")
