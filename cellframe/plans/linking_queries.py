"""Linking, tracking and event tables."""

from pyspark.sql import functions as F

from ..functions.lineage_cut import cut
from ..operators import linking as k
from ..operators import tracker as tr
from .registry import query
from .track_sql import GREEDY_ROWS, STANDARD, STANDARD_CELLS, STANDARD_ROWS, greedy

IMG = "fov:l peak:l t:l "
REG = IMG + "label:l "
_RG = "rg AS (SELECT fov, peak, t, label, y, min_y, max_y, area, major AS length FROM regions)"
_LV = "lv AS (SELECT fov, peak, t + 1 AS t, label AS leaf, y, min_y, max_y, area, length FROM rg)"
_LINK = """ln AS (SELECT * FROM (SELECT r.fov, r.peak, r.t, r.label, l.leaf, abs(r.y - l.y) AS distance,
  row_number() OVER (PARTITION BY r.fov, r.peak, r.t, r.label ORDER BY abs(r.y - l.y), l.leaf) AS p
  FROM rg r JOIN lv l ON l.fov = r.fov AND l.peak = r.peak AND l.t = r.t) q WHERE p = 1)"""


def _grow(c, r):
    return f"({r}.length <= {c}.length*1.5 AND {r}.length >= {c}.length*0.7 AND {r}.area <= {c}.area*1.5 AND {r}.area >= {c}.length*0.7 " \
           f"AND {r}.y >= {c}.min_y AND {r}.y <= {c}.max_y)"


LIMITS = dict(max_len=1.5, min_len=0.7, max_area=1.5, min_area=0.7)


def _regions(d):
    return d.stored_regions.withColumn("length", F.col("major"))


def _leaves(d):
    return _regions(d).select("fov", "peak", (F.col("t") + 1).alias("t"), F.col("label").alias("leaf"), *k.SHAPE)


@query("k1_growth_predicate", REG + "next_label:l", f"""{_RG} ----
SELECT a.fov, a.peak, a.t, a.label, b.label AS next_label FROM rg a JOIN rg b ON b.fov = a.fov AND b.peak = a.peak AND b.t = a.t + 1
WHERE {_grow('a', 'b')}""", uses="regions")
def _(d):
    return k.growing_pairs(_regions(d), **LIMITS)


@query("k2_division_classifier", IMG + "leaf:l first:l second:l decision:l", f"""{_RG}, {_LV}, {_LINK},
rk AS (SELECT *, row_number() OVER (PARTITION BY fov, peak, t, leaf ORDER BY distance, label) AS k FROM ln),
two AS (SELECT fov, peak, t, leaf, min(label) AS a, max(label) AS b FROM rk WHERE k <= 2 GROUP BY ALL HAVING count(*) = 2) ----
SELECT w.fov, w.peak, w.t, w.leaf, w.a AS "first", w.b AS "second", CASE WHEN {_grow('c', 'x')} THEN 1 WHEN {_grow('c', 'z')} THEN 2
  WHEN x.length + z.length <= c.length*1.5 AND x.length + z.length >= c.length*0.7 AND x.y >= c.min_y AND x.y <= c.y AND z.y >= c.y AND z.y <= c.max_y
  THEN 3 ELSE 0 END AS decision
FROM two w JOIN lv c USING (fov, peak, t, leaf) JOIN rg x ON x.fov = w.fov AND x.peak = w.peak AND x.t = w.t AND x.label = w.a
JOIN rg z ON z.fov = w.fov AND z.peak = w.peak AND z.t = w.t AND z.label = w.b""", uses="regions")
def _(d):
    leaves, regions = _leaves(d), _regions(d)
    return k.divisions(leaves, regions, k.nearest_leaf(leaves, regions), **LIMITS)


@query("k3_nearest_leaf", REG + "leaf:l distance:d", f"{_RG}, {_LV}, {_LINK} ---- SELECT * FROM ln", uses="regions")
def _(d):
    return k.nearest_leaf(_leaves(d), _regions(d))


@query("k4_two_closest", REG + "leaf:l rank:l kept:l", f"""{_RG}, {_LV}, {_LINK} ----
SELECT fov, peak, t, label, leaf, row_number() OVER (PARTITION BY fov, peak, t, leaf ORDER BY distance, label) AS rank,
  CASE WHEN row_number() OVER (PARTITION BY fov, peak, t, leaf ORDER BY distance, label) <= 2 THEN 1 ELSE 0 END AS kept FROM ln""", uses="regions")
def _(d):
    return k.two_closest(k.nearest_leaf(_leaves(d), _regions(d)))


TRACK = "fov:l peak:l cell_id:s parent_id:s t:l label:l event:s"


@query("k5_lineage_tracker", TRACK, f"{STANDARD} ---- {STANDARD_ROWS}", uses="regions")
def _(d):
    return tr.track(_regions(d), **LIMITS)


@query("k5_tracked_cells", "fov:l peak:l cell_id:s parent_id:s birth_time:l last_time:l n_obs:l child1_id:s child2_id:s", f"""{STANDARD}, {STANDARD_CELLS} ----
SELECT c.*, k.child1_id, k.child2_id FROM cells_ c LEFT JOIN kids k USING (cell_id)""", uses="regions")
def _(d):
    return tr.tracked_cells(tr.track(_regions(d), **LIMITS))


def _id(t, label):
    return f"printf('f%02dp%04dt%04dr%02d', fov, peak, {t}, {label})"


_EDGES = f"""fr AS (SELECT DISTINCT fov, peak, t FROM pixels),
b AS (SELECT *, min(t) OVER (PARTITION BY fov, peak) AS t0, max(t) OVER (PARTITION BY fov, peak) AS t1 FROM fr),
rb AS (SELECT r.*, b.t0, b.t1, {_id('r.t', 'r.label')} AS node FROM region_probs r JOIN b USING (fov, peak, t)),
e AS (
SELECT fov, peak, t, 'A' AS src, printf('appear_%04d', t) AS dst, 'start' AS type, 0.75E0 AS weight FROM b WHERE t = t0
UNION ALL SELECT fov, peak, t, 'A', printf('born_%04d', t), 'start', 0.75E0 FROM b WHERE t = t0
UNION ALL SELECT fov, peak, t, printf('dies_%04d', t - 1), printf('dies_%04d', t), 'die', 1.1E0 FROM b WHERE t > t0
UNION ALL SELECT fov, peak, t, printf('disappear_%04d', t - 1), printf('disappear_%04d', t), 'disappear', 1.1E0 FROM b WHERE t > t0
UNION ALL SELECT fov, peak, t, printf('born_%04d', t - 1), printf('born_%04d', t), 'born', 0.75E0 FROM b WHERE t > t0
UNION ALL SELECT fov, peak, t, printf('appear_%04d', t - 1), printf('appear_%04d', t), 'appear', 0.75E0 FROM b WHERE t > t0
UNION ALL SELECT fov, peak, t, printf(n || '_%04d', t), 'B', 'end', 1 FROM b, (SELECT unnest(['appear', 'disappear', 'born', 'dies']) AS n) s WHERE t = t1
UNION ALL SELECT fov, peak, t, 'A', node, 'start', 1 FROM rb WHERE t = t0
UNION ALL SELECT fov, peak, t, node, 'B', 'end', 1 FROM rb WHERE t = t1
UNION ALL SELECT fov, peak, t, printf('appear_%04d', t - 1), node, 'appear', p_appear FROM rb WHERE t > t0
UNION ALL SELECT fov, peak, t, printf('born_%04d', t - 1), node, 'born', p_born FROM rb WHERE t > t0
UNION ALL SELECT fov, peak, t, node, printf('disappear_%04d', t + 1), 'disappear', p_disappear FROM rb WHERE t < t1
UNION ALL SELECT fov, peak, t, node, printf('dies_%04d', t + 1), 'die', p_die FROM rb WHERE t < t1
UNION ALL SELECT fov, peak, t, {_id('t', 'label')}, {_id('t + 1', 'next_label')}, 'child', p_child FROM probs
UNION ALL SELECT fov, peak, t, {_id('t', 'label')}, {_id('t + 1', 'next_label')}, 'migrate', p_migrate FROM probs)"""


def _edges(d):
    return k.track_edges(d.stacks, d.stored_regions, d.probs, d.region_probs)


@query("k7_candidate_edges", IMG + "src:s dst:s type:s weight:d score:d", f"{_EDGES} ---- SELECT *, ln(weight) AS score FROM e",
       uses="probs region_probs")
def _(d):
    return _edges(d)


@query("k8_best_edge", "fov:l peak:l src:s dst:s type:s score:d", f"""{_EDGES} ----
SELECT fov, peak, src, dst, type, ln(weight) AS score FROM (SELECT *, row_number() OVER (PARTITION BY fov, peak, src, dst ORDER BY ln(weight) DESC, type) AS p
  FROM e) q WHERE p = 1""", uses="probs region_probs")
def _(d):
    return k.best_edge(_edges(d))


@query("k8_edges_of_type", "fov:l peak:l src:s dst:s score:d", f"{_EDGES} ---- SELECT *, ln(weight) AS score FROM e WHERE type = 'child'",
       uses="probs region_probs")
def _(d):
    return k.edges_of_type(_edges(d), kind="child")


@query("k9_greedy_tracks", TRACK, f"{greedy('ln(0.1)', 'ln(0.5)')} ---- {GREEDY_ROWS}", uses="probs region_probs")
def _(d):
    return tr.greedy_tracks(d.stored_regions, _edges(d))


@query("k10_greedy_tracks_without_limits", TRACK, f"{greedy(None, None)} ---- {GREEDY_ROWS}", uses="probs region_probs")
def _(d):
    return tr.greedy_tracks(d.stored_regions, _edges(d), min_score=None, second=None)


@query("k11_unvisited_nodes", "fov:l peak:l n:l", f"""{_RG} ----
SELECT a.fov, a.peak, sum(CASE WHEN EXISTS (SELECT 1 FROM rg b WHERE b.fov = a.fov AND b.peak = a.peak AND b.t = a.t + 1 AND {_grow('a', 'b')}) THEN 0 ELSE 1 END) AS n
FROM rg a GROUP BY a.fov, a.peak""", uses="regions")
def _(d):
    return k.unvisited(d.stored_regions, k.growing_pairs(_regions(d), **LIMITS))


# ---- event tables ----

_FAMILY = """fam AS (SELECT cell_id, parent_id, CASE WHEN child1_id IN (SELECT cell_id FROM cells) THEN child1_id END AS c1,
  CASE WHEN child2_id IN (SELECT cell_id FROM cells) THEN child2_id END AS c2, death FROM cells)"""
_SEEN = """o AS (SELECT *, lead(label) OVER w AS nl, min(t) OVER (PARTITION BY cell_id) AS a, max(t) OVER (PARTITION BY cell_id) AS z,
  count(*) OVER (PARTITION BY cell_id) AS n, row_number() OVER w AS i FROM {t} WINDOW w AS (PARTITION BY cell_id ORDER BY t)),
seen AS (SELECT o.*, f.parent_id, f.c1, f.c2, f.death FROM o JOIN fam f USING (cell_id) WHERE {gap}),
st AS (SELECT cell_id, arg_min(label, t) AS label FROM {t} GROUP BY cell_id),
links AS (SELECT fov, peak, t, label, nl AS next_label FROM seen WHERE t < z
  UNION SELECT s.fov, s.peak, s.t, s.label, x.label FROM seen s JOIN st x ON x.cell_id = s.c1 JOIN st y ON y.cell_id = s.c2 WHERE s.t = s.z
  UNION SELECT s.fov, s.peak, s.t, s.label, y.label FROM seen s JOIN st x ON x.cell_id = s.c1 JOIN st y ON y.cell_id = s.c2 WHERE s.t = s.z
  UNION SELECT fov, peak, t, label, 0 FROM seen WHERE t = z AND c1 IS NULL
  UNION SELECT fov, peak, t, label, 0 FROM reg WHERE (fov, peak, t, label) NOT IN (SELECT (fov, peak, t, label) FROM seen))"""
# long observations lie in later frames, so that many cells have gaps
_GAPPED = "go AS (SELECT * REPLACE (t + CASE WHEN length >= 5.8 THEN 100000 ELSE 0 END AS t) FROM cell_obs)"
_REGS = "reg AS (SELECT DISTINCT fov, peak, t, label FROM go)"


def _family(d):
    here = d.cells.select("cell_id")
    c = d.cells.select("cell_id", "parent_id", "child1_id", "child2_id", "death")
    for n in ("child1_id", "child2_id"):
        c = c.join(here.select(F.col("cell_id").alias(n), F.lit(True).alias(f"_{n}")), n, "left").withColumn(
            n, F.when(F.col(f"_{n}"), F.col(n))).drop(f"_{n}")
    return c


def _gapped(d):
    return cut(d.cell_obs.withColumn("t", F.col("t") + F.when(F.col("length") >= 5.8, 100000).otherwise(0)))


_EV = "migrate:l divide:l die:l born:l appear:l disappear:l false_join:l one_cell:l two_cells:l three_cells:l zero_cells:l no_data:l"
_EVENTS_SQL = """SELECT r.fov, r.peak, r.t, r.label, coalesce(max(CASE WHEN s.t < s.z THEN 1 ELSE 0 END), 0) AS migrate,
  coalesce(max(CASE WHEN s.t = s.z AND c1 IS NOT NULL THEN 1 ELSE 0 END), 0) AS divide, coalesce(max(CASE WHEN s.t = s.z AND death = 1 THEN 1 ELSE 0 END), 0) AS die,
  coalesce(max(CASE WHEN s.t = s.a AND parent_id IS NOT NULL THEN 1 ELSE 0 END), 0) AS born,
  coalesce(max(CASE WHEN s.t = s.a AND parent_id IS NULL AND s.t <> 1 THEN 1 ELSE 0 END), 0) AS appear,
  coalesce(max(CASE WHEN s.t = s.z AND c1 IS NULL THEN 1 ELSE 0 END), 0) AS disappear, 0 AS false_join, 1 AS one_cell, 0 AS two_cells, 0 AS three_cells,
  0 AS zero_cells, CASE WHEN count(s.cell_id) = 0 THEN 1 ELSE 0 END AS no_data
FROM reg r LEFT JOIN seen s USING (fov, peak, t, label) GROUP BY r.fov, r.peak, r.t, r.label"""


@query("k12_region_events", REG + _EV, f"{_FAMILY}, {_GAPPED}, {_REGS}, {_SEEN.format(t='go', gap='z - a + 1 <= n')} ---- {_EVENTS_SQL}",
       uses="cells cell_obs")
def _(d):
    obs = _gapped(d)
    return k.region_events(obs, _family(d), obs)


@query("k13_region_links", REG + "next_label:l", f"{_FAMILY}, {_GAPPED}, {_REGS}, {_SEEN.format(t='go', gap='z - a + 1 <= n')} ---- SELECT * FROM links",
       uses="cells cell_obs")
def _(d):
    obs = _gapped(d)
    return k.region_links(obs, _family(d), obs)


@query("k14_apply_overrides", REG + "next_label:l", f"""{_FAMILY}, {_GAPPED}, {_REGS}, {_SEEN.format(t='go', gap='z - a + 1 <= n')},
nw AS (SELECT fov, peak, t, label, 0 AS next_label FROM reg WHERE label = 2) ----
SELECT * FROM links WHERE (fov, peak, t, label) NOT IN (SELECT (fov, peak, t, label) FROM nw) UNION ALL SELECT * FROM nw""", uses="cells cell_obs")
def _(d):
    obs = _gapped(d)
    links = k.region_links(obs, _family(d), obs)
    new = obs.where("label = 2").select(*k.REGION).distinct().withColumn("next_label", F.lit(0))
    return k.apply_overrides(links, new)


@query("k15_merge_last_wins", "cell_id:l sb:d src:s", """
SELECT cell_id, CASE WHEN tau > 25 THEN sd ELSE sb END AS sb, CASE WHEN tau > 25 THEN 'new' ELSE 'old' END AS src FROM cells""", uses="cells")
def _(d):
    old = d.cells.select("cell_id", "sb", F.lit("old").alias("src"))
    new = d.cells.where("tau > 25").select("cell_id", F.col("sd").alias("sb"), F.lit("new").alias("src"))
    return k.merge_last([old, new])


# foci seen at half the time resolution, so that times repeat
_FOCI = """fo AS (SELECT cell_id, fov, peak, t // 2 AS t, arg_min(label, t) AS label FROM cell_obs GROUP BY cell_id, fov, peak, t // 2),
reg AS (SELECT DISTINCT fov, peak, t // 2 AS t, label FROM cell_obs)"""


def _foci(d):
    half = d.obs.select(F.col("cell_id").alias("focus_id"), "fov", "peak", F.floor(F.col("t") / 2).alias("t"), "label",
                             F.col("t").alias("seq"))
    return half, _family(d).withColumnRenamed("cell_id", "focus_id"), k.distinct_times(half, order="seq")


@query("k16_focus_events", REG + "migrate:l split:l appear:l disappear:l no_data:l", f"{_FAMILY}, {_FOCI}, {_SEEN.format(t='fo', gap='true')} ---- "
       f"SELECT fov, peak, t, label, migrate, divide AS split, appear, disappear, no_data FROM ({_EVENTS_SQL}) v", uses="cells cell_obs")
def _(d):
    regions, foci, obs = _foci(d)
    return k.focus_events(regions, foci, obs)


@query("k16_focus_links", REG + "next_label:l", f"{_FAMILY}, {_FOCI}, {_SEEN.format(t='fo', gap='true')} ---- SELECT * FROM links", uses="cells cell_obs")
def _(d):
    regions, foci, obs = _foci(d)
    return k.focus_links(regions, foci, obs)
