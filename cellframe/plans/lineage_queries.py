"""Recursive lineage queries; the ``_of_filtered`` forms run on trees broken by a size filter."""

from pyspark.sql import functions as F

from ..operators import lineage as l
from ..operators.filters import filter_by_cutoffs
from .registry import query

# the cells that a size filter leaves, so that chains break
_SET = {False: "cs AS (SELECT * FROM cells)", True: "cs AS (SELECT * FROM cells WHERE sb <= 2.6 AND tau <= 29)"}


def _cells(d, broken):
    if not broken:
        return d.cells
    return filter_by_cutoffs(d.cells, spec={"sb": {"xhi": 2.6}, "tau": {"xhi": 29}})


_ANC = """anc AS (
SELECT c.cell_id, p.cell_id AS ancestor_id, p.parent_id AS nxt, 1 AS steps FROM cs c JOIN cs p ON p.cell_id = c.parent_id
UNION ALL
SELECT a.cell_id, p.cell_id, p.parent_id, a.steps + 1 FROM anc a JOIN cs p ON p.cell_id = a.nxt),
gap AS (SELECT c.cell_id, count(a.ancestor_id) AS generations FROM cs c LEFT JOIN anc a ON a.cell_id = c.cell_id GROUP BY c.cell_id)"""
_DOWN = """down AS (
SELECT cell_id, cell_id AS cur, child1_id AS nxt, 0 AS steps FROM cs
UNION ALL
SELECT d.cell_id, p.cell_id, p.child1_id, d.steps + 1 FROM down d JOIN cs p ON p.cell_id = d.nxt),
ends AS (SELECT cell_id, arg_max(cur, steps) AS last_id FROM down GROUP BY cell_id)"""
_CELL = "cell_id:l fov:l peak:l birth_time:l sb:d"

for _broken in (False, True):
    _x = "_of_filtered" if _broken else ""
    _own = _SET[_broken]

    @query("l2_ancestors" + _x, "cell_id:l ancestor_id:l steps:l", f"{_own}, {_ANC} ---- SELECT * FROM anc", uses="cells")
    def _(d, b=_broken):
        return l.ancestors(_cells(d, b))

    @query("l3_generation_gap" + _x, "cell_id:l generations:l", f"{_own}, {_ANC} ---- SELECT * FROM gap", uses="cells")
    def _(d, b=_broken):
        return l.generation_gap(_cells(d, b))

    @query("l4_last_daughter" + _x, "cell_id:l last_id:l", f"{_own}, {_DOWN} ---- SELECT * FROM ends", uses="cells")
    def _(d, b=_broken):
        return l.last_daughter(_cells(d, b))

    @query("l5_lineages_of_length" + _x, _CELL, f"""{_own}, {_ANC}, {_DOWN},
q AS (SELECT DISTINCT e.last_id FROM ends e JOIN gap g ON g.cell_id = e.last_id WHERE g.generations >= 4) ----
SELECT * FROM cs WHERE cell_id IN (SELECT last_id FROM q)
  OR cell_id IN (SELECT ancestor_id FROM anc WHERE cell_id IN (SELECT last_id FROM q))""", uses="cells")
    def _(d, b=_broken):
        return l.lineages_of_length(_cells(d, b), n_gens=4)

    @query("l5_lineages_without_ends" + _x, _CELL, f"""{_own}, {_ANC}, {_DOWN},
q AS (SELECT DISTINCT e.last_id FROM ends e JOIN gap g ON g.cell_id = e.last_id WHERE g.generations >= 3) ----
SELECT * FROM cs WHERE cell_id IN (SELECT a.ancestor_id FROM anc a JOIN gap g ON g.cell_id = a.ancestor_id
  WHERE a.cell_id IN (SELECT last_id FROM q) AND g.generations > 0)""", uses="cells")
    def _(d, b=_broken):
        return l.lineages_of_length(_cells(d, b), n_gens=3, remove_ends=True)

    @query("l6_continuous_lineages" + _x, _CELL, f"""{_own}, {_DOWN},
kept AS (SELECT c.* FROM cs c JOIN specs s ON s.fov = c.fov AND s.peak = c.peak WHERE s.spec = 1),
f AS (SELECT fov, peak, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY fov, peak ORDER BY birth_time, cell_id) AS k
   FROM kept WHERE birth_time < 50 AND division_time >= 50 AND division_time < 90) x WHERE k = 1),
last AS (SELECT fov, peak, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY fov, peak ORDER BY birth_time DESC, cell_id DESC) AS k
   FROM kept) x WHERE k = 1),
sel AS (SELECT f.* FROM f JOIN last USING (fov, peak) JOIN ends e ON e.cell_id = f.cell_id JOIN cs c ON c.cell_id = e.last_id
  WHERE f.cell_id <> last.cell_id AND c.birth_time > 90) ----
SELECT k.* FROM kept k JOIN sel ON sel.fov = k.fov AND sel.peak = k.peak WHERE k.birth_time >= 50 OR k.cell_id = sel.cell_id""",
           uses="cells specs")
    def _(d, b=_broken):
        return l.continuous_lineages(_cells(d, b), d.specs, t1=50, t2=90)

    @query("l7_mother_lineages" + _x, "lineage_id:l position:l length:l cell_id:l", f"""{_own}, {_ANC},
leaf AS (SELECT cell_id FROM cs WHERE birth_label = 1 AND child1_id NOT IN (SELECT cell_id FROM cs)
  AND child2_id NOT IN (SELECT cell_id FROM cs)) ----
SELECT l.cell_id AS lineage_id, g.generations - a.steps AS position, g.generations + 1 AS length, a.ancestor_id AS cell_id
FROM leaf l JOIN gap g ON g.cell_id = l.cell_id JOIN (SELECT cell_id, ancestor_id, steps FROM anc
  UNION ALL SELECT cell_id, cell_id, 0 FROM cs) a ON a.cell_id = l.cell_id""", uses="cells")
    def _(d, b=_broken):
        return l.mother_lineages(_cells(d, b))

    @query("l9_lineage_export" + _x, "fov:l channel_id:l cell_id:l replicative_age:l t:l length:d division:l birth:l",
           f"""{_own},
roots AS (SELECT *, row_number() OVER (PARTITION BY fov, peak ORDER BY birth_time, cell_id) AS k FROM cs
  WHERE parent_id IS NULL OR parent_id NOT IN (SELECT cell_id FROM cs)),
per AS (SELECT fov, peak, count(*) AS n FROM roots GROUP BY fov, peak),
base AS (SELECT a.fov, a.peak, 10 + coalesce(sum((b.n // 10)*10 + 10), 0) AS base
  FROM per a LEFT JOIN per b ON b.fov = a.fov AND b.peak < a.peak GROUP BY a.fov, a.peak),
line AS (SELECT r.cell_id, r.child1_id AS nxt, r.fov, b.base + r.k AS channel_id, 0 AS age FROM roots r JOIN base b USING (fov, peak)
  UNION ALL SELECT c.cell_id, c.child1_id, l.fov, l.channel_id, l.age + 1 FROM line l JOIN cs c ON c.cell_id = l.nxt) ----
SELECT l.fov, l.channel_id, l.cell_id, l.age AS replicative_age, o.t, o.length,
  CASE WHEN o.t = max(o.t) OVER (PARTITION BY o.cell_id) THEN 1 ELSE 0 END AS division,
  CASE WHEN o.t = min(o.t) OVER (PARTITION BY o.cell_id) THEN 1 ELSE 0 END AS birth
FROM line l JOIN cell_obs o ON o.cell_id = l.cell_id""", uses="cells cell_obs")
    def _(d, b=_broken):
        return l.lineage_export(_cells(d, b), d.cell_obs)

    _POLE = """pole AS (
SELECT cell_id, child1_id, child2_id, 1000 AS a, 0 AS b FROM cs WHERE birth_label = 1
UNION ALL
SELECT c.cell_id, c.child1_id, c.child2_id, CASE WHEN c.cell_id = p.child1_id THEN p.a + 1 ELSE 0 END,
  CASE WHEN c.cell_id = p.child1_id THEN 0 ELSE p.b + 1 END
FROM pole p JOIN cs c ON c.cell_id IN (p.child1_id, p.child2_id) AND c.parent_id = p.cell_id
WHERE c.birth_label <> 1 AND NOT (p.a = 1000 AND c.cell_id = p.child1_id))"""

    @query("l10_pole_age" + _x, "cell_id:l pole_closed:l pole_open:l", f"""{_own}, {_POLE} ----
SELECT c.cell_id, p.a AS pole_closed, p.b AS pole_open FROM cs c LEFT JOIN pole p USING (cell_id)""", uses="cells")
    def _(d, b=_broken):
        return l.pole_age(_cells(d, b))

    _COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM z WHERE {w}" for n, w in {
        "all cells": "true", "with pole age": "a IS NOT NULL", "without pole age": "a IS NULL", "mothers": "a = 1000",
        "01 cells": "a = 0 AND b = 1 AND r <= 2", "10 cells": "a = 1 AND b = 0 AND r <= 3", "02 cells": "a = 0 AND b = 2",
        "other pole age": "a IS NOT NULL AND a <> 1000 AND NOT (a = 0 AND b = 1 AND r <= 2) "
                          "AND NOT (a = 1 AND b = 0 AND r <= 3) AND NOT (a = 0 AND b = 2)",
        "r1 cells": "r = 1", "r2 cells": "r = 2", "r3 cells": "r = 3", "r4 cells": "r = 4", "r>4 cells": "r > 4"}.items())

    @query("l11_pole_counts" + _x, "name:s n:l", f"""{_own}, {_POLE},
z AS (SELECT c.cell_id, c.birth_label AS r, p.a, p.b FROM cs c LEFT JOIN pole p USING (cell_id)) ----
{_COUNTS}""", uses="cells")
    def _(d, b=_broken):
        return l.pole_counts(_cells(d, b))


@query("l1_organise_by_channel", _CELL, """
SELECT c.* FROM cells c WHERE (c.fov, c.peak) IN (SELECT (fov, peak) FROM specs WHERE spec = 1)""", uses="cells specs")
def _(d):
    return l.by_channel(d.cells, d.specs)


@query("l8_select_lineages", "lineage_id:l position:l length:l cell_id:l", f"""{_SET[True]}, {_ANC},
leaf AS (SELECT cell_id FROM cs WHERE birth_label = 1 AND child1_id NOT IN (SELECT cell_id FROM cs)
  AND child2_id NOT IN (SELECT cell_id FROM cs)) ----
SELECT l.cell_id AS lineage_id, g.generations - a.steps AS position, g.generations + 1 AS length, a.ancestor_id AS cell_id
FROM leaf l JOIN gap g ON g.cell_id = l.cell_id JOIN (SELECT cell_id, ancestor_id, steps FROM anc
  UNION ALL SELECT cell_id, cell_id, 0 FROM cs) a ON a.cell_id = l.cell_id WHERE g.generations + 1 >= 3""", uses="cells")
def _(d):
    return l.select_lineages(l.mother_lineages(_cells(d, True)), min_gen=3)


@query("l12_mother_daughter", "cell_id:l parent_id:l mother:d daughter:d", """
SELECT c.cell_id, c.parent_id, p.sb AS mother, c.sb AS daughter FROM cells c JOIN cells p ON p.cell_id = c.parent_id""",
       uses="cells")
def _(d):
    return l.mother_daughter(d.cells, attr="sb")


@query("l12_autocorrelation", "attr:s r:d n:l", " UNION ALL ".join(
    f"SELECT '{a}' AS attr, corr(p.{a}, c.{a}) AS r, count(*) AS n FROM cells c JOIN cells p ON p.cell_id = c.parent_id"
    for a in ("sb", "delta", "elong_rate")), uses="cells")
def _(d):
    return l.autocorrelation(d.cells, attrs=["sb", "delta", "elong_rate"])


@query("l13_trace_connectors", "prev_id:l cell_id:l fov:l peak:l t:l y0:d y1:d", """
SELECT prev_id, cell_id, fov, peak, birth_time AS t, prev_sd AS y0, sb AS y1
FROM (SELECT *, lag(cell_id) OVER w AS prev_id, lag(division_time) OVER w AS pd, lag(sd) OVER w AS prev_sd FROM cells
  WINDOW w AS (PARTITION BY fov, peak ORDER BY birth_time, cell_id)) x WHERE pd = birth_time""", uses="cells")
def _(d):
    return l.connectors(d.cells)


@query("l13_parent_connectors", "parent_id:l cell_id:l t0:l y0:d t1:l y1:d", """
SELECT c.parent_id, c.cell_id, p.division_time AS t0, p.sd AS y0, c.birth_time AS t1, c.sb AS y1
FROM cells c JOIN cells p ON p.cell_id = c.parent_id""", uses="cells")
def _(d):
    return l.parent_connectors(d.cells)


@query("l14_lineage_series", "lineage_id:l position:l cell_id:l elong_rate:d delta:d sb:d", f"""{_SET[False]}, {_ANC},
leaf AS (SELECT cell_id FROM cs WHERE birth_label = 1 AND child1_id NOT IN (SELECT cell_id FROM cs)
  AND child2_id NOT IN (SELECT cell_id FROM cs)) ----
SELECT l.cell_id AS lineage_id, g.generations - a.steps AS position, a.ancestor_id AS cell_id, c.elong_rate, c.delta, c.sb
FROM leaf l JOIN gap g ON g.cell_id = l.cell_id JOIN (SELECT cell_id, ancestor_id, steps FROM anc
  UNION ALL SELECT cell_id, cell_id, 0 FROM cs) a ON a.cell_id = l.cell_id JOIN cs c ON c.cell_id = a.ancestor_id""",
       uses="cells")
def _(d):
    return l.lineage_series(d.cells, attrs=["elong_rate", "delta", "sb"])
