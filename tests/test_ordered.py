"""Sliced windows and exact quantiles against pandas, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellframe.functions.ordered import neighbour, positions, quantiles, quantiles_long, running
from cellframe.operators import filters, stats


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 40, 3000)), "t": rng.integers(0, 500, 3000),
                        "i": np.arange(3000), "v": np.round(rng.normal(size=3000), 1)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("back", [True, False])
def test_neighbour(hot, back):
    pdf, df = hot
    got = neighbour(df, ["k"], ["t", "i"], {"v": "near"}, back=back, span=7).toPandas().sort_values("i")
    want = pdf.sort_values(["k", "t", "i"]).groupby("k")["v"].shift(1 if back else -1).sort_index()
    np.testing.assert_array_equal(got["near"].astype(float).to_numpy(), want.to_numpy())


def test_running(hot):
    pdf, df = hot
    got = running(df, ["k"], ["t", "i"], index="n", sums={"v": "s"}, tops={"v": "m"}, totals=True, span=11).toPandas().sort_values("i")
    by = pdf.sort_values(["k", "t", "i"]).groupby("k")["v"]
    np.testing.assert_array_equal(got["n"].to_numpy(), (by.cumcount() + 1).sort_index().to_numpy())
    np.testing.assert_allclose(got["s"].to_numpy(), by.cumsum().sort_index().to_numpy(), atol=1e-9)
    np.testing.assert_array_equal(got["m"].to_numpy(), by.cummax().sort_index().to_numpy())
    np.testing.assert_allclose(got["s_all"].to_numpy(), by.transform("sum").sort_index().to_numpy(), atol=1e-9)


def test_null_keys_and_times_stay(spark):
    """Rows with a null key or a null time are kept and ordered as by a plain window."""
    rows = [(None, 1, 1.0), (None, 2, 2.0), (1, None, 3.0), (1, 4, 4.0), (1, 1500, 5.0), (None, None, 6.0), (2, 7, None)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    plain = Window.partitionBy("k").orderBy("t")
    want = df.select("*", F.lag("v").over(plain).alias("near"), F.row_number().over(plain).alias("n"),
                     F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = running(neighbour(df, ["k"], ["t"], {"v": "near"}), ["k"], ["t"], index="n", sums={"v": "s"})
    assert sorted(((r.k, r.t, r.v, r.near, r.n) for r in got.collect()), key=str) == sorted(((r.k, r.t, r.v, r.near, r.n) for r in want.collect()), key=str)
    placed = positions(df.groupBy("k", "v").agg(F.count("*").alias("w")), ["k"], "v", "w").collect()
    assert len(placed) == len(rows) and {r["_total"] for r in placed if r.k is None} == {3}


def test_columns_of_nulls_keep_their_row(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r.name: r for r in stats.stats_table(df, cols=("a", "b")).collect()}
    assert got["a"].median == 1.5 and got["b"].median is None and got["b"].mean is None
    assert {r.name for r in filters.cutoff_summary(df, cols=("a", "b")).collect()} == {"a", "b"}
    assert [tuple(r) for r in filters.cutoffs(df, col="b", method="median").collect()] == [(None, None)]


def test_quantiles_by_group(hot):
    pdf, df = hot
    got = quantiles(df, ["v", "t"], {"a": 0.1, "m": 0.5, "z": 1.0}, by=["k"]).toPandas()
    assert len(got) == 2 * pdf["k"].nunique()
    for r in got.itertuples():
        x = pdf.loc[pdf["k"] == r.k, r.name]
        np.testing.assert_allclose([r.a, r.m, r.z], np.quantile(x, [0.1, 0.5, 1.0]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    (row,) = quantiles_long(df, ["v"], [p]).collect()
    assert np.isclose(row["q"], np.quantile(values, p), rtol=1e-9, atol=1e-6)


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit(2).alias("w"))
    got = positions(df, ["g"], "v", "w").toPandas()
    assert (got["_before"] == 2 * (got["v"] // 3)).all()
    assert set(got["_total"]) == {2 * 333, 2 * 334}
