"""Cell-cycle annotation queries."""

from ..operators import cycle as y
from .registry import query

USES = "cells cell_obs cell_cycle"
_VOL = "(({l} - {w})*pi()*({w}/2)*({w}/2) + 4/3.0E0*pi()*({w}/2)*({w}/2)*({w}/2))"
_INIT = """init AS (
SELECT * FROM (SELECT c.cell_id, k.n_oc, k.id AS init_cell_id, c.initiation_time, c.termination_time, o.length AS il, w.width AS iw,
  row_number() OVER (PARTITION BY c.cell_id ORDER BY k.n_oc) AS pick
  FROM cell_cycle c JOIN (
    SELECT cell_id, 1 AS n_oc, cell_id AS id FROM cells
    UNION ALL SELECT cell_id, 2, parent_id FROM cells
    UNION ALL SELECT c.cell_id, 3, m.parent_id FROM cells c JOIN cells m ON m.cell_id = c.parent_id
    UNION ALL SELECT c.cell_id, 4, g.parent_id FROM cells c JOIN cells m ON m.cell_id = c.parent_id JOIN cells g ON g.cell_id = m.parent_id
  ) k ON k.cell_id = c.cell_id JOIN cells w ON w.cell_id = k.id
  JOIN cell_obs o ON o.cell_id = k.id AND o.t = c.initiation_time) x WHERE pick = 1)"""
_SEG = f"""seg AS (SELECT c.cell_id, y.seg_time AS s, o.length AS l, {_VOL.format(l='o.length', w='c.width')} AS v
  FROM cells c JOIN cell_cycle y USING (cell_id) JOIN cell_obs o ON o.cell_id = c.cell_id AND o.t = y.seg_time)"""
_TERM = f"""term AS (SELECT c.cell_id, o.length AS l, {_VOL.format(l='o.length', w='c.width')} AS v
  FROM cells c JOIN init i USING (cell_id) JOIN cell_obs o ON o.cell_id = c.cell_id AND o.t = i.termination_time
  WHERE i.termination_time <> 0)"""


def _init(d):
    return y.initiation_cell(d.cells, d.obs, d.cell_cycle)


@query("y1_initiation_cell", "cell_id:l initiation_time:l termination_time:l n_oc:l init_cell_id:l",
       f"{_INIT} ---- SELECT * FROM init", uses=USES)
def _(d):
    return _init(d)


@query("y2_initiation_size", "cell_id:l n_oc:l true_initiation_length:d initiation_length:d true_initiation_volume:d "
       "initiation_volume:d unit_cell:d", f"""{_INIT}, pop AS (SELECT avg(width) AS w FROM cells) ----
SELECT cell_id, n_oc, il AS true_initiation_length, il/power(2, n_oc - 1) AS initiation_length,
  {_VOL.format(l='il', w='iw')} AS true_initiation_volume, {_VOL.format(l='il', w='iw')}/power(2, n_oc - 1) AS initiation_volume,
  {_VOL.format(l='(il/power(2, n_oc - 1))', w='w')}*ln(2) AS unit_cell FROM init, pop""", uses=USES)
def _(d):
    return y.initiation_size(d.cells, _init(d))


@query("y3_cycle_periods", "cell_id:l B:d C:d D:d tau_cyc:d", f"""{_INIT} ----
SELECT cell_id, (birth_time - initiation_time)*3 AS B, (termination_time - initiation_time)*3 AS C,
  (division_time - termination_time)*3 AS D, (division_time - initiation_time)*3 AS tau_cyc
FROM (SELECT i.*, c.birth_time, c.division_time FROM init i JOIN cells c USING (cell_id)) x""", uses=USES)
def _(d):
    return y.cycle_periods(d.cells, _init(d), time_int=3)


@query("y4_initiation_delta", "cell_id:l delta:d", f"""{_INIT} ----
SELECT c.cell_id, 2*b.il/power(2, b.n_oc - 1) - a.il/power(2, a.n_oc - 1) AS delta
FROM cells c JOIN init a ON a.cell_id = c.cell_id JOIN init b ON b.cell_id = c.child1_id""", uses=USES)
def _(d):
    return y.daughter_delta(d.cells, y.initiation_size(d.cells, _init(d)), attr="initiation_length")


@query("y5_segregation", "cell_id:l segregation_time:l segregation_length:d segregation_volume:d S:d IS:d TS:d "
       "segregation_delta:d segregation_delta_mother:d segregation_length_mother:d", f"""{_INIT}, {_SEG} ----
SELECT c.cell_id, s.s AS segregation_time, s.l AS segregation_length, s.v AS segregation_volume,
  (c.division_time - s.s)*3 AS "S", CASE WHEN i.initiation_time <> 0 THEN (s.s - i.initiation_time)*3 END AS "IS",
  CASE WHEN i.initiation_time <> 0 THEN (s.s - i.termination_time)*3 END AS "TS", 2*d.l - s.l AS segregation_delta,
  2*s.l - m.l AS segregation_delta_mother, m.l AS segregation_length_mother
FROM cells c JOIN seg s ON s.cell_id = c.cell_id LEFT JOIN init i ON i.cell_id = c.cell_id
LEFT JOIN seg d ON d.cell_id = c.child1_id LEFT JOIN seg m ON m.cell_id = c.parent_id""", uses=USES)
def _(d):
    return y.segregation(d.cells, d.obs, d.cell_cycle, _init(d), time_int=3)


@query("y6_termination", "cell_id:l termination_length:d termination_volume:d termination_delta:d", f"""{_INIT}, {_TERM} ----
SELECT c.cell_id, t.l AS termination_length, t.v AS termination_volume, 2*d.l - t.l AS termination_delta
FROM cells c JOIN term t ON t.cell_id = c.cell_id LEFT JOIN term d ON d.cell_id = c.child1_id""", uses=USES)
def _(d):
    return y.termination(d.cells, d.obs, _init(d))


@query("y7_attach_attributes", "cell_id:l sb:d initiation:l", """
SELECT cell_id, sb, initiation_time AS initiation FROM cells LEFT JOIN cell_cycle USING (cell_id)""", uses=USES)
def _(d):
    return y.attach_attributes(d.cells, d.cell_cycle, rename={"initiation_time": "initiation"})
