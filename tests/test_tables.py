"""Sources, sinks and properties of the table operators."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cellframe.functions.lineage_cut import shared_dir
from cellframe.operators import cells as c
from cellframe.operators import channels as ch
from cellframe.operators import filters as f
from cellframe.operators import stats as s
from cellframe.plans import all_oracles, all_queries
from cellframe.sources import catalog, sinks
from check import compare


def test_scan_images(spark, tmp_path):
    for name in ("e_t0001xy01c1.tif", "e_t0002xy01c1.tif", "e_t0002xy02c1.tif", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = catalog.scan_images(spark, str(tmp_path), t_start=2, fovs=[1]).collect()
    assert [(r.plane, r.fov, r.t) for r in got] == [("c1", 1, 2)]
    assert "content" not in got[0].asDict()


def test_path_without_match(spark):
    row = catalog.parse_image_path(spark.createDataFrame([("plain.tif",)], "path string")).first()
    assert (row.plane, row.fov, row.t) == (None, None, None)


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("file_path,include\na.pkl,1\nb.pkl,0\n")
    assert [r.file_path for r in catalog.read_registry(spark, str(tmp_path / "r.csv")).collect()] == ["a.pkl"]
    reg = spark.createDataFrame([("a", 0)], "file_path string, include int")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "file_path string")
    once = catalog.registry_add(reg, new)
    assert sorted(map(tuple, catalog.registry_add(once, new).collect())) == [("a", 0), ("b", 1)]


def _long_frames(spark, tmp_path):
    """Events whose numbers pass six digits, so that images share names."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ids = [5, 100000, 1000001, 1000003, 1000004, 1000006, 1000007, 1000008, 1000009, 999999]
    rows = [(i, None, i % 10, "a", 1.0, '{"k": %d}' % (i % 4 * 30)) for i in ids]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["s3_metadata_json", "s9_registry_add"])
def test_images_that_share_a_name(spark, tmp_path, name):
    con = _long_frames(spark, tmp_path)
    ok, note = compare(all_queries()[name](spark, str(tmp_path)), con, all_oracles()[name])
    assert ok, note


def test_folder_filters_reach_the_scan(demo, spark, tmp_path):
    demo.stacks.write.partitionBy("fov", "peak", "plane").parquet(str(tmp_path / "s"))
    plan = catalog.read_stacks(spark, str(tmp_path / "s"), fovs=[1], peaks=[2])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\(fov#\d+ = 1\), \(peak#\d+ = 2\)\], PushedFilters: \[\]", plan)


def test_one_json_record_per_cell(spark):
    obs = spark.range(2500).select(F.lit(1).alias("cell_id"), F.col("id").alias("t"), F.lit(1.0).alias("length"))
    parts = sinks.nested_cells(spark.createDataFrame([(1,)], "cell_id int"), obs).collect()
    assert [len(p.obs) for p in parts] == [2500]


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or shared_dir(spark))


def test_filters_are_idempotent(demo):
    once = f.filter_by_cutoffs(demo.cells, spec={"sb": {"xlo": 1.2, "xhi": 2.5}})
    assert once.count() == f.filter_by_cutoffs(once, spec={"sb": {"xlo": 1.2, "xhi": 2.5}}).count() < demo.cells.count()
    assert f.by_fov_peaks(demo.cells, mapping=None) is demo.cells
    assert f.born_before(demo.cells) is demo.cells


def test_missing_values_survive_cutoffs(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "x double")
    assert sorted(map(str, (r.x for r in f.filter_by_cutoffs(df, spec={"x": {"xlo": 0, "xhi": 5}}).collect()))) == ["1.0", "None"]
    assert f.filter_by_cutoffs(df, spec={"x": {"xlo": 2}}).count() == 2


def test_complete_needs_both_relatives(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None)], "parent_id int, child1_id int")
    assert f.complete(df).count() == 1


@pytest.mark.parametrize("bins", ["sturges", 13])
def test_density_integrates_to_one(demo, bins):
    rows = s.histogram(demo.cells, col="sd", bins=bins, kind="step").collect()
    assert math.isclose(sum((r.right - r.left) * r.density for r in rows), 1, rel_tol=1e-9)


def test_division_adds_up(demo):
    d = c.division_summary(demo.cells, demo.cell_obs, px2um=0.1).where("abs(sd - sb - delta) > 1e-9 OR septum_position NOT BETWEEN 0 AND 1")
    assert d.isEmpty()


def test_bilinear_fit_finds_the_kink(spark):
    y = [0.1 * t if t <= 6 else 0.6 + 0.3 * (t - 6) for t in range(13)]
    obs = spark.createDataFrame([(1, t, math.exp(v)) for t, v in enumerate(y)], "cell_id int, t int, length double")
    r = c.bilinear_fit(obs).first()
    assert (r.t_shift, round(r.slope1, 6), round(r.slope2, 6), round(r.r2, 6)) == (6, 0.1, 0.3, 1.0)


def test_hot_channel_fills_gaps(spark):
    frames = spark.range(50).select(F.lit(1).alias("fov"), F.lit(0).alias("peak"), F.col("id").alias("t"))
    det = frames.where("t IN (1, 2, 30)").withColumn("area", F.col("t") * 2)
    got = {r.t: r.source_t for r in ch.fill_missing_frames(frames, det).collect()}
    assert got == {0: 1, 1: 1, **{t: 2 for t in range(2, 30)}, **{t: 30 for t in range(30, 50)}}


def test_statistics_agree_with_pandas(demo):
    pdf = demo.cells.select("sb", "tau").toPandas()
    got = {r.name: r for r in s.stats_table(demo.cells, cols=["sb", "tau"]).collect()}
    for n in ("sb", "tau"):
        assert math.isclose(got[n]["std"], pdf[n].std()) and math.isclose(got[n]["median"], pdf[n].median())


def test_ridges_find_channels_of_two_widths_and_no_noise(spark):
    """Hats of two widths on an uneven, noisy ground; the noise has maxima of its own."""
    draw = random.Random(4)
    centres = {40: 4, 90: 9, 140: 4, 200: 9}
    def value(x):
        return 1000 + 2 * draw.random() + sum(300 * math.exp(-0.5 * ((x - c) / w) ** 2) for c, w in centres.items())
    rows = [(1, 0, 0, x, value(x)) for x in range(240)]
    got = ch.ridge_peaks(spark.createDataFrame(rows, "fov int, peak int, t int, x int, s double"), widths=range(3, 12), separation=20, image_width=240,
                               snr=10.0, min_length=4).collect()
    found = sorted(r.x for r in got)
    assert len(found) == len(centres) and all(abs(x - c) <= 2 for x, c in zip(found, sorted(centres)))
    border = ch.ridge_peaks(spark.createDataFrame(rows, "fov int, peak int, t int, x int, s double"), widths=range(3, 12), separation=84, image_width=240,
                                  snr=10.0, min_length=4)
    assert sorted(r.x for r in border.collect()) == found[1:3]
