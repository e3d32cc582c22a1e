"""Oracle SQL of the trackers: one step of a recursive query takes every channel one frame (or one walk) further.

Written from the rules, not from the operators: leaves are rows of the working table, and
window functions do what the operators do with lists.
"""

_GROWS = ("({c}.length * 0.7 <= {r}.length AND {r}.length <= {c}.length * 1.5 AND {c}.length * 0.7 <= {r}.area AND {r}.area <= {c}.area * 1.5 "
          "AND {c}.min_y <= {r}.y AND {r}.y <= {c}.max_y)")
_NAME = "printf('f%02dp%04dt%04dr%02d', fov, peak, t, label)"


def grows(c: str, r: str) -> str:
    return _GROWS.format(c=c, r=r)


#: rows of kind tick keep a channel going, leaf are its open cells in order of ord, out are results
STANDARD = f"""rg AS (SELECT fov, peak, t, label, y, min_y, max_y, area, major AS length FROM regions),
ends AS (SELECT fov, peak, min(t) AS t0, max(t) AS t1 FROM rg GROUP BY fov, peak),
tk AS (
  SELECT fov, peak, CAST(t0 - 1 AS BIGINT) AS t, 'tick' AS kind, CAST(0 AS BIGINT) AS ord, '' AS id, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS label, 0.0E0 AS y,
    0.0E0 AS min_y, 0.0E0 AS max_y, 0.0E0 AS area, 0.0E0 AS length, CAST(NULL AS VARCHAR) AS parent, '' AS event FROM ends
  UNION ALL
  SELECT * FROM (
    WITH last AS (SELECT * FROM tk WHERE kind <> 'out'),
    tick AS (SELECT l.fov, l.peak, l.t + 1 AS t FROM last l JOIN ends e USING (fov, peak) WHERE l.kind = 'tick' AND l.t < e.t1),
    aged AS (SELECT l.*, k.t AS now, k.t - l.seen > 3 AS lost, row_number() OVER (PARTITION BY fov, peak ORDER BY ord)
        - row_number() OVER (PARTITION BY fov, peak, k.t - l.seen > 3 ORDER BY ord) AS run
      FROM last l JOIN tick k USING (fov, peak) WHERE l.kind = 'leaf'),
    odd AS (SELECT *, row_number() OVER (PARTITION BY fov, peak, lost, run ORDER BY ord) AS place FROM aged),
    lv AS (SELECT *, row_number() OVER (PARTITION BY fov, peak ORDER BY ord) AS i FROM odd WHERE NOT (lost AND place % 2 = 1)),
    rr AS (SELECT r.*, r.y < 150 AND r.label <= 4 AS near FROM rg r JOIN tick USING (fov, peak, t)),
    free AS (SELECT * FROM rr WHERE near AND (fov, peak) NOT IN (SELECT (fov, peak) FROM lv)),
    gap AS (SELECT r.*, l.i, abs(r.y - l.y) AS d, row_number() OVER (PARTITION BY r.fov, r.peak, r.label ORDER BY abs(r.y - l.y), l.i) AS best
      FROM rr r JOIN lv l USING (fov, peak)),
    lk AS (SELECT *, row_number() OVER (PARTITION BY fov, peak, i ORDER BY d, label) AS p, count(*) OVER (PARTITION BY fov, peak, i) AS n FROM gap WHERE best = 1),
    more AS (SELECT *, bool_and(near) OVER (PARTITION BY fov, peak, i ORDER BY p ROWS UNBOUNDED PRECEDING) AS opens FROM lk WHERE p > 2),
    two AS (SELECT *, row_number() OVER (PARTITION BY fov, peak, i ORDER BY label) AS side, least(n, 2) AS m FROM lk WHERE p <= 2),
    duo AS (SELECT l.fov, l.peak, l.i, l.id AS leaf, CASE WHEN a.m = 1 AND {grows('l', 'a')} THEN 1 WHEN a.m = 1 THEN 0
        WHEN {grows('l', 'a')} THEN 1 WHEN {grows('l', 'b')} THEN 2
        WHEN l.length * 0.7 <= a.length + b.length AND a.length + b.length <= l.length * 1.5 AND l.min_y <= a.y AND a.y <= l.y AND l.y <= b.y AND b.y <= l.max_y
        THEN 3 ELSE 0 END AS decision
      FROM lv l JOIN two a ON a.fov = l.fov AND a.peak = l.peak AND a.i = l.i AND a.side = 1
      LEFT JOIN two b ON b.fov = l.fov AND b.peak = l.peak AND b.i = l.i AND b.side = 2),
    act AS (SELECT w.*, d.leaf, d.decision, CASE WHEN d.decision = 3 THEN 'daughter' WHEN d.decision = w.side THEN 'grow' WHEN d.decision > 0 AND w.near THEN 'start' END AS event
      FROM two w JOIN duo d USING (fov, peak, i)),
    made AS (
      SELECT fov, peak, t, label, y, min_y, max_y, area, length, label AS ord, near, 'start' AS event, CAST(NULL AS VARCHAR) AS parent FROM free
      UNION ALL SELECT fov, peak, t, label, y, min_y, max_y, area, length, 1000000 + i * 1000 + p, near, 'start', NULL FROM more WHERE opens
      UNION ALL SELECT fov, peak, t, label, y, min_y, max_y, area, length, 2000000 + i * 1000 + side, near, event, CASE WHEN event = 'daughter' THEN leaf END FROM act
        WHERE event IN ('daughter', 'start'))
    SELECT fov, peak, t, 'tick', 0, '', 0, 0, 0.0E0, 0.0E0, 0.0E0, 0.0E0, 0.0E0, NULL, '' FROM tick
    UNION ALL SELECT l.fov, l.peak, l.now, 'leaf', l.i, l.id, CASE WHEN g.label IS NULL THEN l.seen ELSE l.now END, coalesce(g.label, l.label), coalesce(g.y, l.y),
        coalesce(g.min_y, l.min_y), coalesce(g.max_y, l.max_y), coalesce(g.area, l.area), coalesce(g.length, l.length), NULL, ''
      FROM lv l LEFT JOIN (SELECT * FROM act WHERE event = 'grow') g ON g.fov = l.fov AND g.peak = l.peak AND g.i = l.i
      WHERE (l.fov, l.peak, l.i) NOT IN (SELECT (fov, peak, i) FROM duo WHERE decision = 3)
    UNION ALL SELECT fov, peak, t, 'leaf', ord, {_NAME}, t, label, y, min_y, max_y, area, length, NULL, '' FROM made WHERE near
    UNION ALL SELECT fov, peak, t, 'out', 0, {_NAME}, 0, label, 0.0E0, 0.0E0, 0.0E0, 0.0E0, 0.0E0, parent, event FROM made
    UNION ALL SELECT fov, peak, t, 'out', 0, leaf, 0, label, 0.0E0, 0.0E0, 0.0E0, 0.0E0, 0.0E0, NULL, 'grow' FROM act WHERE event = 'grow') step)"""

STANDARD_ROWS = "SELECT fov, peak, id AS cell_id, parent AS parent_id, t, label, event FROM tk WHERE kind = 'out'"

STANDARD_CELLS = """cells_ AS (SELECT fov, peak, id AS cell_id, arg_min(parent, t) AS parent_id, min(t) AS birth_time, max(t) AS last_time, count(*) AS n_obs
  FROM tk WHERE kind = 'out' GROUP BY fov, peak, id),
kids AS (SELECT parent AS cell_id, arg_min(id, label) AS child1_id, CASE WHEN count(*) > 1 THEN arg_max(id, label) END AS child2_id
  FROM tk WHERE kind = 'out' AND event = 'daughter' GROUP BY parent)"""


def greedy(min_score: str | None, second: str | None) -> str:
    """Greedy walks: a row per channel holds its walks; a step starts a frame (k = 0), moves walk k, or ends the frame (k beyond the last walk)."""
    weak = f"CASE WHEN -m < {min_score} THEN 'disappear' ELSE kind END" if min_score else "kind"
    enough = f"AND -m >= {second}" if second else ""
    name = lambda t, label: f"printf('f%02dp%04dt%04dr%02d', fov, peak, {t}, {label})"
    out = lambda cell, parent, t, label, event: f"{{'cell': {cell}, 'parent': {parent}, 't': {t}, 'label': {label}, 'event': {event}}}"
    none, walks, made, outs = ("CAST(NULL AS VARCHAR)", "CAST([] AS STRUCT(label BIGINT, cell VARCHAR)[])", "CAST([] AS STRUCT(label BIGINT, parent VARCHAR)[])",
                               "CAST([] AS STRUCT(cell VARCHAR, parent VARCHAR, t BIGINT, label BIGINT, event VARCHAR)[])")
    me = "walks[k]"
    grown = out(f"{me}.cell", none, "t + 1", "dst", "'grow'")
    ended = out(f"{me}.cell", none, "t", f"{me}.label", "act")
    return f"""fr AS (SELECT DISTINCT fov, peak, t FROM pixels),
b AS (SELECT fov, peak, min(t) AS t0, max(t) AS t1 FROM fr GROUP BY fov, peak),
nd AS (SELECT fov, peak, CAST(t AS BIGINT) AS t, CAST(label AS BIGINT) AS label FROM regions),
ed AS (SELECT fov, peak, CAST(t AS BIGINT) AS t, CAST(label AS BIGINT) AS label, CAST(dst AS BIGINT) AS dst, kind, ln(w) AS score FROM (
  SELECT fov, peak, t, label, next_label AS dst, 'child' AS kind, p_child AS w FROM probs
  UNION ALL SELECT fov, peak, t, label, next_label, 'migrate', p_migrate FROM probs
  UNION ALL SELECT fov, peak, t, label, NULL, 'disappear', p_disappear FROM region_probs JOIN b USING (fov, peak) WHERE t < t1
  UNION ALL SELECT fov, peak, t, label, NULL, 'die', p_die FROM region_probs JOIN b USING (fov, peak) WHERE t < t1
  UNION ALL SELECT fov, peak, t, label, NULL, 'end', 1 FROM region_probs JOIN b USING (fov, peak) WHERE t = t1) q),
gt AS (
  SELECT fov, peak, CAST(t0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS k, {walks} AS walks, {walks} AS onward, CAST([] AS BIGINT[]) AS visited, {made} AS made, {outs} AS outs FROM b
  UNION ALL
  SELECT * FROM (
    WITH s AS (SELECT * FROM gt WHERE k >= 0),
    lab AS (SELECT s.fov, s.peak, list(n.label ORDER BY n.label) AS found FROM s JOIN nd n ON n.fov = s.fov AND n.peak = s.peak AND n.t = s.t WHERE s.k = 0
      AND NOT list_contains(list_transform(s.walks, lambda w: w.label), n.label) GROUP BY s.fov, s.peak),
    op AS (SELECT s.fov, s.peak, -e.score AS m, coalesce(e.dst, -1) AS dst, e.kind,
        row_number() OVER (PARTITION BY s.fov, s.peak ORDER BY -e.score, CASE WHEN e.dst IS NULL THEN 1 ELSE 0 END, coalesce(e.dst, -1), e.kind) AS p
      FROM s JOIN ed e ON e.fov = s.fov AND e.peak = s.peak AND e.t = s.t AND e.label = s.walks[s.k].label
      WHERE s.k BETWEEN 1 AND len(s.walks) AND (e.dst IS NULL OR NOT list_contains(s.visited, e.dst))),
    ch AS (SELECT fov, peak, m, dst, {weak} AS act FROM op WHERE p = 1),
    ot AS (SELECT s.fov, s.peak, e.dst AS dst2, -e.score AS m, row_number() OVER (PARTITION BY s.fov, s.peak ORDER BY -e.score, e.dst) AS q
      FROM s JOIN ch c ON c.fov = s.fov AND c.peak = s.peak AND c.act = 'child'
      JOIN ed e ON e.fov = s.fov AND e.peak = s.peak AND e.t = s.t AND e.label = s.walks[s.k].label AND e.kind = 'child' AND e.dst <> c.dst
      WHERE NOT list_contains(s.visited, e.dst)),
    sec AS (SELECT fov, peak, dst2 FROM ot WHERE q = 1 {enough}),
    mv AS (SELECT s.*, c.act, c.dst, o.dst2 FROM s LEFT JOIN ch c ON c.fov = s.fov AND c.peak = s.peak LEFT JOIN sec o ON o.fov = s.fov AND o.peak = s.peak
      WHERE s.k BETWEEN 1 AND len(s.walks))
    SELECT s.fov, s.peak, t, 1, list_concat(walks, list_transform(coalesce(found, []), lambda x: {{'label': x, 'cell': {name('t', 'x').replace('fov, peak', 's.fov, s.peak')}}})), {walks}, CAST([] AS BIGINT[]), {made},
      list_transform(list_filter(coalesce(found, []), lambda x: NOT list_contains(list_transform(made, lambda d: d.label), x)), lambda x: {out(name('t', 'x').replace('fov, peak', 's.fov, s.peak'), none, 't', 'x', "'start'")})
      FROM s LEFT JOIN lab ON lab.fov = s.fov AND lab.peak = s.peak WHERE k = 0
    UNION ALL SELECT fov, peak, t, k + 1, walks,
      CASE act WHEN 'migrate' THEN list_append(onward, {{'label': dst, 'cell': {me}.cell}}) WHEN 'child' THEN list_append(onward, {{'label': dst, 'cell': {name('t + 1', 'dst')}}}) ELSE onward END,
      CASE WHEN act IN ('migrate', 'child') THEN list_append(visited, dst) ELSE visited END,
      CASE WHEN act = 'child' THEN list_concat(list_filter(made, lambda d: d.label <> dst AND d.label <> coalesce(dst2, -1)),
        CASE WHEN dst2 IS NULL THEN [{{'label': dst, 'parent': {me}.cell}}] ELSE [{{'label': dst, 'parent': {me}.cell}}, {{'label': dst2, 'parent': {me}.cell}}] END) ELSE made END,
      CASE WHEN act = 'migrate' THEN [{grown}] WHEN act IN ('disappear', 'die') THEN [{ended}] ELSE {outs} END FROM mv
    UNION ALL SELECT s.fov, s.peak, CASE WHEN t < t1 THEN t + 1 ELSE t END, CASE WHEN t < t1 THEN 0 ELSE -1 END, onward, {walks}, CAST([] AS BIGINT[]), made,
      list_transform(made, lambda d: {out(name('t + 1', 'd.label').replace('fov, peak', 's.fov, s.peak'), 'd.parent', 't + 1', 'd.label', "'daughter'")})
      FROM s JOIN b ON b.fov = s.fov AND b.peak = s.peak WHERE k > len(walks)) step)"""


GREEDY_ROWS = "SELECT fov, peak, o.cell AS cell_id, o.parent AS parent_id, o.t AS t, o.label AS label, o.event AS event FROM (SELECT fov, peak, unnest(outs) AS o FROM gt) r"
