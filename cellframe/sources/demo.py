"""Lineage and image tables derived from the benchmark's parquet tables.

Every view covers its whole source table. The Spark form and the SQL form (used
only by the oracle) are written separately, so that they check each other.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage_cut import cut

SIDE = 8  # the embedding vectors are read as 8x8 images
PIECE = 250_000  # observations that a task sorts and counts at once


class Demo:
    """Lazy access to the derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        """Fifty channels; in each the cells form a complete binary tree in heap order."""
        base = self.raw("orders").select(
            F.col("o_orderkey").alias("cell_id"),
            (F.col("o_orderkey") % 50).alias("c"),
            F.floor(F.col("o_orderkey") / 50).cast("long").alias("n"),
            (1 + (F.col("o_totalprice") % 1000) / 500).alias("sb"),
            (1 + (F.col("o_custkey") % 100) / F.lit(50.0)).alias("delta"),
            (20 + (F.col("o_orderkey") % 11).cast("double")).alias("tau"),
            (F.lit(0.8) + (F.col("o_custkey") % 20) / F.lit(100.0)).alias("width"),
            (F.lit(0.4) + (F.col("o_orderkey") % 21) / F.lit(100.0)).alias("septum_position"),
            (F.col("o_orderstatus") == "P").cast("int").alias("death"))
        base = base.withColumn("g", F.floor(F.log(F.col("n") + 1) / F.log(F.lit(2.0)) + F.lit(1e-9)).cast("long"))
        n, c, g = F.col("n"), F.col("c"), F.col("g")
        return base.select(
            "cell_id",
            (1 + F.floor(c / 10)).cast("int").alias("fov"), (c % 10).cast("int").alias("peak"),
            F.when(n > 0, F.floor((n - 1) / 2).cast("long") * 50 + c).alias("parent_id"),
            ((2 * n + 1) * 50 + c).alias("child1_id"), ((2 * n + 2) * 50 + c).alias("child2_id"),
            (n + 2 - F.pow(F.lit(2.0), g).cast("long")).alias("birth_label"),
            (g * 20 + c % 7).alias("birth_time"), ((g + 1) * 20 + c % 7).alias("division_time"),
            "sb", (F.col("sb") + F.col("delta")).alias("sd"), "delta", "tau", "width", "septum_position",
            (F.log((F.col("sb") + F.col("delta")) / F.col("sb")) / F.col("tau") * 60).alias("elong_rate"),
            "death")

    @cached_property
    def n_items(self) -> int:
        """Rows of the table of observations, from the footers of its files."""
        return self.raw("lineitem").count()

    def by_cell(self, df: DataFrame) -> DataFrame:
        """Observations dealt by cell to pieces of about ``PIECE`` rows, however large the table is.

        Windows, sums and joins by cell keep the pieces, so what a task holds does not grow with
        the table. The session's own number of partitions would make larger ones.
        """
        if self.n_items <= PIECE:
            return df
        return df.repartition(max(math.ceil(self.n_items / PIECE), self.spark.sparkContext.defaultParallelism), "cell_id")

    @cached_property
    def cell_obs(self) -> DataFrame:
        order = Window.partitionBy("cell_id").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
        items = self.by_cell(self.raw("lineitem").withColumnRenamed("l_orderkey", "cell_id")).select(
            "cell_id", F.col("l_linenumber").cast("int").alias("label"),
            (1 + F.col("l_quantity") / 10).alias("length"), (F.lit(0.8) + F.col("l_tax")).alias("width"),
            (F.col("l_quantity") * 10).alias("area"), F.col("l_extendedprice").alias("fl_total"),
            (F.row_number().over(order) - 1).alias("i"))
        born = self.cells.select("cell_id", "fov", "peak", "birth_time")
        return items.join(born, "cell_id").select(
            "cell_id", "fov", "peak", (F.col("birth_time") + F.col("i")).alias("t"), "label", "length", "width",
            "area", "fl_total", ((F.col("birth_time") + F.col("i")) * 180).alias("seconds"))

    @cached_property
    def obs(self) -> DataFrame:
        """The observations as a written table, for queries that read them several times."""
        return cut(self.cell_obs)

    @cached_property
    def cell_cycle(self) -> DataFrame:
        """Annotations; a third of the cells lacks the initiation and another third the termination."""
        third = F.col("cell_id") % 3
        return self.cells.select(
            "cell_id", F.when(third != 1, F.col("birth_time") - 20 * (F.col("cell_id") % 5)).alias("initiation_time"),
            F.when(third != 2, F.col("division_time") - 10).alias("termination_time"), (F.col("birth_time") + 1).alias("seg_time"))

    @cached_property
    def specs(self) -> DataFrame:
        return self.cells.select("fov", "peak").distinct().withColumn(
            "spec", F.when(F.col("peak") == 9, 0).when(F.col("peak") == 8, -1).otherwise(1))

    @cached_property
    def focus_obs(self) -> DataFrame:
        return self.foci_of(self.cell_obs)

    @staticmethod
    def foci_of(obs: DataFrame) -> DataFrame:
        return obs.select("cell_id", "fov", "peak", "t", F.col("label").alias("focus_label"),
                        ((F.col("length") - 3) * 2).alias("disp_l"), ((F.col("width") - 0.84) * 10).alias("disp_w"),
                        F.col("fl_total").alias("foci_h"))

    @cached_property
    def frames(self) -> DataFrame:
        e = self.raw("events")
        fov = 1 + F.col("user_id") % 5
        return e.select(
            "event_id", fov.alias("fov"), F.col("event_id").alias("t"),
            (F.lit(2460310) + F.col("event_id") * F.lit(0.002)).alias("jd"),
            F.concat(F.lit("exp_t"), F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit("xy"),
                     F.lpad(fov.cast("string"), 2, "0"), F.lit("c1.tif")).alias("path"), "props")

    @cached_property
    def profiles(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("cell_id"), F.col("label").alias("size_bin"),
            F.transform("embedding", lambda v: v.cast("double")).alias("profile"))

    @cached_property
    def stacks(self) -> DataFrame:
        """One image per row: five fields of view with ten channels, frame after frame."""
        v = F.col("vec_id")
        return self.raw("embeddings").select(
            (1 + F.floor(v / 10) % 5).cast("int").alias("fov"), (v % 10).cast("int").alias("peak"),
            F.floor(v / 50).cast("int").alias("t"), F.lit("c1").alias("plane"),
            F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
            F.transform("embedding", lambda p: F.floor(p.cast("double") * 1000 + 1000).cast("int")).alias("px"))

    @cached_property
    def pixels(self) -> DataFrame:
        flat = self.stacks.select("fov", "peak", "t", F.posexplode("px").alias("pos", "v"))
        return flat.select("fov", "peak", "t", F.floor(F.col("pos") / SIDE).cast("int").alias("y"),
                           (F.col("pos") % SIDE).cast("int").alias("x"), "v")

    @cached_property
    def labels(self) -> DataFrame:
        """Bright pixels, labelled by image quadrant."""
        return self.pixels.where("v > 1000").select(
            "fov", "peak", "t", "y", "x",
            (1 + 2 * F.floor(F.col("y") / 4) + F.floor(F.col("x") / 4)).cast("int").alias("label"))

    @cached_property
    def label_images(self) -> DataFrame:
        """The labels as one image per row, zero between regions."""
        label = lambda v, i: F.when(v > 1000, (1 + 2 * F.floor(i / 32) + F.floor(i % SIDE / 4)).cast("int")).otherwise(0)
        return self.stacks.select("fov", "peak", "t", "height", "width", F.transform("px", label).alias("lab"))

    @cached_property
    def masks(self) -> DataFrame:
        return self.stacks.withColumn("px", F.transform("px", lambda v: F.when(v > 1000, 1).otherwise(0)))

    @cached_property
    def regions(self) -> DataFrame:
        from ..operators.regions import region_props
        return region_props(self.labels)

    @cached_property
    def stored_regions(self) -> DataFrame:
        """The regions as a written table, for queries that read them several times."""
        return cut(self.regions)

    @cached_property
    def probs(self) -> DataFrame:
        """Class probabilities of every region pair of consecutive frames, from the region sizes."""
        a = self.stored_regions.select("fov", "peak", "t", "label", F.col("area").alias("a"))
        b = self.stored_regions.select("fov", "peak", (F.col("t") - 1).alias("t"), F.col("label").alias("next_label"),
                                F.col("area").alias("b"))
        least, most = F.least("a", "b").cast("double"), F.greatest("a", "b").cast("double")
        return a.join(b, ["fov", "peak", "t"]).select(
            "fov", "peak", "t", "label", "next_label",
            (least / (most + 1) / (1 + F.abs(F.col("label") - F.col("next_label")))).alias("p_migrate"),
            (least / (most + 2) / (1 + F.abs(2 * F.col("label") - F.col("next_label")))).alias("p_child"))

    @cached_property
    def region_probs(self) -> DataFrame:
        """Class probabilities of single regions."""
        a = F.col("area")
        return self.stored_regions.select("fov", "peak", "t", "label", (1 / (1 + a)).alias("p_appear"),
                                   (a / (a + 10.0)).alias("p_born"), (1 / (2 + a)).alias("p_disappear"),
                                   (1 / (3.0 + a)).alias("p_die"))

    @cached_property
    def boxes(self) -> DataFrame:
        """Channel boxes found in single frames, jittered around regular positions."""
        x1 = 40 * (F.col("l_partkey") % 25) + F.col("l_linenumber")
        return self.raw("lineitem").select(
            (1 + F.col("l_suppkey") % 5).alias("fov"), F.col("l_orderkey").alias("t"), x1.alias("min_col"),
            (x1 + 20).alias("max_col"), (100 + F.col("l_linenumber")).alias("min_row"),
            (350 + F.col("l_linenumber") + F.col("l_partkey") % 3).alias("max_row"))


# The same views as SQL, for the oracle only.
VIEWS: dict[str, tuple[str, str]] = {
    "cells": ("", """
SELECT o_orderkey AS cell_id, 1 + CAST(floor(c/10.0) AS INT) AS fov, CAST(c % 10 AS INT) AS peak,
  CASE WHEN n > 0 THEN CAST(floor((n-1)/2.0) AS BIGINT)*50 + c END AS parent_id,
  (2*n+1)*50 + c AS child1_id, (2*n+2)*50 + c AS child2_id,
  n + 2 - CAST(power(2, g) AS BIGINT) AS birth_label,
  g*20 + c % 7 AS birth_time, (g+1)*20 + c % 7 AS division_time,
  sb, sb + delta AS sd, delta, tau, width, septum_position,
  ln((sb+delta)/sb)/tau*60 AS elong_rate, death
FROM (SELECT *, CAST(floor(ln(n+1)/ln(2) + 1e-9) AS BIGINT) AS g,
   1 + (o_totalprice % 1000)/500 AS sb, 1 + (o_custkey % 100)/CAST(50 AS DOUBLE) AS delta,
   20 + CAST(o_orderkey % 11 AS DOUBLE) AS tau, 0.8E0 + (o_custkey % 20)/CAST(100 AS DOUBLE) AS width,
   0.4E0 + (o_orderkey % 21)/CAST(100 AS DOUBLE) AS septum_position,
   CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS death
  FROM (SELECT *, o_orderkey % 50 AS c, CAST(floor(o_orderkey/50.0) AS BIGINT) AS n FROM orders) a) b"""),
    "cell_obs": ("cells", """
SELECT l_orderkey AS cell_id, c.fov, c.peak, c.birth_time + i - 1 AS t, l_linenumber AS label,
  1 + l_quantity/10 AS length, 0.8E0 + l_tax AS width, l_quantity*10 AS area, l_extendedprice AS fl_total,
  (c.birth_time + i - 1)*180 AS seconds
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem) l
JOIN cells c ON c.cell_id = l.l_orderkey"""),
    "cell_cycle": ("cells", """
SELECT cell_id, CASE WHEN cell_id % 3 <> 1 THEN birth_time - 20*(cell_id % 5) END AS initiation_time,
  CASE WHEN cell_id % 3 <> 2 THEN division_time - 10 END AS termination_time, birth_time + 1 AS seg_time FROM cells"""),
    "specs": ("cells", """
SELECT DISTINCT fov, peak, CASE WHEN peak = 9 THEN 0 WHEN peak = 8 THEN -1 ELSE 1 END AS spec FROM cells"""),
    "focus_obs": ("cell_obs", """
SELECT cell_id, fov, peak, t, label AS focus_label, (length - 3)*2 AS disp_l,
  (width - 0.84E0)*10 AS disp_w, fl_total AS foci_h FROM cell_obs"""),
    "frames": ("", """
SELECT event_id, 1 + user_id % 5 AS fov, event_id AS t, 2460310 + event_id*CAST(0.002 AS DOUBLE) AS jd,
  concat('exp_t', lpad(CAST(event_id AS VARCHAR), 6, '0'), 'xy',
         lpad(CAST(1 + user_id % 5 AS VARCHAR), 2, '0'), 'c1.tif') AS path, props FROM events"""),
    "profiles": ("", "SELECT vec_id AS cell_id, label AS size_bin, embedding AS profile FROM embeddings"),
    "pixels": ("", """
SELECT CAST(1 + (vec_id // 10) % 5 AS INT) AS fov, CAST(vec_id % 10 AS INT) AS peak, CAST(vec_id // 50 AS INT) AS t,
  CAST((i-1) // 8 AS INT) AS y, CAST((i-1) % 8 AS INT) AS x,
  CAST(floor(CAST(embedding[i] AS DOUBLE)*1000 + 1000) AS INT) AS v
FROM embeddings, unnest(range(1, 65)) r(i)"""),
    "labels": ("pixels", """
SELECT fov, peak, t, y, x, 1 + 2*(y // 4) + x // 4 AS label FROM pixels WHERE v > 1000"""),
    "regions": ("labels", """
SELECT *, atan2(round(2*c, 9) + 0.0, round(vx - vy, 9) + 0.0)/-2 AS orientation,
  4*sqrt((vy+vx)/2 + sqrt((vy-vx)*(vy-vx)/4 + c*c)) AS major,
  4*sqrt(greatest((vy+vx)/2 - sqrt((vy-vx)*(vy-vx)/4 + c*c), 0)) AS minor
FROM (SELECT fov, peak, t, label, count(*) AS area, avg(y) AS y, avg(x) AS x, min(y) AS min_y, min(x) AS min_x,
  max(y)+1 AS max_y, max(x)+1 AS max_x, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c
  FROM labels GROUP BY fov, peak, t, label) a"""),
    "probs": ("regions", """
SELECT a.fov, a.peak, a.t, a.label, b.label AS next_label,
  least(a.area, b.area)/CAST(greatest(a.area, b.area) + 1 AS DOUBLE)/(1 + abs(a.label - b.label)) AS p_migrate,
  least(a.area, b.area)/CAST(greatest(a.area, b.area) + 2 AS DOUBLE)/(1 + abs(2*a.label - b.label)) AS p_child
FROM regions a JOIN regions b ON b.fov = a.fov AND b.peak = a.peak AND b.t = a.t + 1"""),
    "region_probs": ("regions", """
SELECT fov, peak, t, label, 1/CAST(1 + area AS DOUBLE) AS p_appear, area/(area + 10.0E0) AS p_born,
  1/CAST(2 + area AS DOUBLE) AS p_disappear, 1/(3.0E0 + area) AS p_die FROM regions"""),
    "boxes": ("", """
SELECT 1 + l_suppkey % 5 AS fov, l_orderkey AS t, 40*(l_partkey % 25) + l_linenumber AS min_col,
  40*(l_partkey % 25) + l_linenumber + 20 AS max_col, 100 + l_linenumber AS min_row,
  350 + l_linenumber + l_partkey % 3 AS max_row FROM lineitem"""),
}


def view_sql(*names: str) -> list[str]:
    """CTE definitions of the named views and of the views they need, in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        needs = VIEWS[name][0]
        for n in needs.split():
            visit(n)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    return [f"{n} AS ({VIEWS[n][1]})" for n in done]
