"""What tasks hold and what travels, for tables larger than a piece."""

import glob
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cellframe.operators import lineage as l
from cellframe.operators import profiles as p
from cellframe.plans import all_oracles, all_queries
from cellframe.sources import demo as source
from cellframe.sources import sinks
from check import TABLES, compare


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_observations_are_dealt_by_cell_to_bounded_pieces(spark, sf, monkeypatch):
    monkeypatch.setattr(source, "PIECE", 250)
    d = source.Demo(spark, sf)
    n = -(-d.n_items // 250)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = d.cell_obs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("c"))
    got = sizes.agg(F.max("n"), F.sum("n"), F.sum("c")).first()
    # no piece is much larger than asked for, and no cell is in two of them
    assert got[0] < 2 * 250 and got[1] == d.n_items and got[2] == d.cell_obs.select("cell_id").distinct().count()


@pytest.mark.parametrize("name", ["c9_bilinear_fit", "c15_cell_foci", "a9_instantaneous_rate", "a9_instantaneous_rate_shifted", "l9_lineage_export",
                                  "l9_lineage_export_of_filtered", "s11_lineage_files", "s12_cells_json", "p14_trace_points"])
def test_pieces_change_no_result(spark, sf, monkeypatch, name):
    monkeypatch.setattr(source, "PIECE", 250)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok, note = compare(all_queries()[name](spark, sf), con, all_oracles()[name])
    assert ok, note


def test_fits_by_cell_keep_the_pieces(spark, sf, monkeypatch):
    monkeypatch.setattr(source, "PIECE", 250)
    plan = _optimized(all_queries()["c9_bilinear_fit"](spark, sf))
    assert plan.index("Union") > plan.index("RepartitionByExpression")


def test_export_reads_observations_once(spark, tmp_path):
    rows = [(1, None, 2, 3), (2, 1, 4, 5), (3, 1, 6, 7)]
    cells = spark.createDataFrame(rows, "cell_id long, parent_id long, child1_id long, child2_id long").selectExpr(
        "*", "1 AS fov", "0 AS peak", "cell_id AS birth_time")
    spark.createDataFrame([(c, t, float(t)) for c in (1, 2, 3, 9) for t in (5, 6, 7)], "cell_id long, t long, length double").write.parquet(str(tmp_path / "o"))
    out = l.lineage_export(cells, spark.read.parquet(str(tmp_path / "o")))
    assert len(re.findall(r"Relation \[cell_id#\d+L,t#\d+L,length#\d+\]", _optimized(out))) == 1
    assert sorted((r.cell_id, r.t, r.birth, r.division) for r in out.collect()) == [
        (c, t, int(t == 5), int(t == 7)) for c in (1, 2) for t in (5, 6, 7)]


def test_trace_points_shuffle_no_unfolded_profiles(spark):
    cells = spark.createDataFrame([(1, 1, 0)], "cell_id long, fov int, peak int")
    # a time that occurs twice meets its focus twice
    obs = spark.createDataFrame([(1, t, 2.0, 8.0, 1.0) for t in (5, 6, 6)], "cell_id long, t long, length double, fl_total double, width double")
    profiles = spark.createDataFrame([(1, 5, [1.0, None, 3.0]), (1, 7, [9.0]), (2, 5, [9.0]), (1, 6, None)], "cell_id long, t long, profile array<double>")
    focus = spark.createDataFrame([(1, 6, 0.5, 4.0), (1, 9, 0.5, 4.0), (3, 6, 0.5, 4.0)], "cell_id long, t long, disp_l double, foci_h double")
    out = p.trace_points(cells, obs, profiles, focus)
    lines = _optimized(out).splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    unfolded = next(i for i, s in enumerate(lines) if "Generate posexplode" in s)
    above, at = [], depth(lines[unfolded])
    for s in reversed(lines[:unfolded]):
        if depth(s) < at:
            above, at = [*above, s], depth(s)
    assert not any("Join" in s for s in above)
    got = sorted((r.part, round(r.hours * 60), r.value, r.scaled) for r in out.collect() if r.value is not None)
    assert [g for g in got if g[0] != "concentration"] == [("focus", 6, 4.0, None)] * 2 + [("profile", 5, 1.0, 0.0), ("profile", 5, 3.0, 1.0)]
    assert [g[:2] for g in got if g[0] == "concentration"] == [("concentration", t) for t in (5, 6, 6)]
    assert out.where("part = 'profile'").count() == 3


def test_json_records_are_compressed(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2.0), (2, 3.0)], "cell_id long, sb double")
    obs = spark.createDataFrame([(1, 5, 2.0), (1, 4, 1.0)], "cell_id long, t long, length double")
    sinks.write_cells_json(cells, obs, str(tmp_path / "j"))
    assert glob.glob(str(tmp_path / "j" / "*.json.gz")) and not glob.glob(str(tmp_path / "j" / "*.json"))
    back = {r.cell_id: r.obs for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert [(o.t, o.length) for o in back[1]] == [(4, 1.0), (5, 2.0)] and back[2] is None
