"""Writers of cells and lineages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import union_all

CSV_COLUMNS = ("cell_id", "fov", "peak", "birth_label", "parent_id", "daughter1_id", "daughter2_id", "birth_time",
               "division_time", "sb", "sd", "delta", "tau", "elong_rate", "width", "septum_position")


def _four_digits(df: DataFrame) -> DataFrame:
    """Floating columns as text with four decimals."""
    return df.withColumns({f.name: F.format_string("%.4f", f.name) for f in df.schema
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_cells_csv(cells: DataFrame, path: str) -> None:
    """Cells in order of channel and birth, one column per daughter."""
    out = cells.withColumnsRenamed({"child1_id": "daughter1_id", "child2_id": "daughter2_id"}).select(*CSV_COLUMNS)
    _four_digits(out.orderBy("fov", "peak", "birth_time", "birth_label", "cell_id")).write.csv(path, header=True)


def write_lineages(lineages: DataFrame, path: str) -> None:
    """Tab-separated lineage tables, one folder per field of view and lineage id."""
    placed = lineages.repartitionByRange("fov", "channel_id", "replicative_age", "t").sortWithinPartitions(
        "fov", "channel_id", "replicative_age", "t")
    _four_digits(placed).write.partitionBy("fov", "channel_id").option("sep", "\t").csv(path, header=True)


def nested_cells(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Cells with their observations as an array of structs: one record per cell.

    A cell's frames from birth to division bound its array.
    """
    item = F.struct(*[c for c in obs.columns if c not in ("cell_id", "fov", "peak")])
    nested = obs.groupBy("cell_id").agg(F.sort_array(F.collect_list(item)).alias("obs"))
    return cells.join(nested, "cell_id", "left")


def write_cells_json(cells: DataFrame, obs: DataFrame, path: str) -> None:
    """One JSON record per cell and line, in gzip files, which take a sixth of the plain text."""
    nested_cells(cells, obs).write.json(path, compression="gzip")


def write_cells(cells: DataFrame, path: str) -> None:
    cells.write.partitionBy("fov", "peak").parquet(path)


def union_experiments(named: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of several experiments in one, told apart by ``exp``."""
    return union_all([df.withColumn("exp", F.lit(n)) for n, df in named.items()])
