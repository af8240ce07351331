"""Rendering what just arrived: fresh granules become tiles in the micro-batch that brought them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.jobs import Layer, render_cached, rendered_keys
from .ingest import fresh_tiles


def stored_keys(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Keys of tiles rendered by earlier batches."""
    schema = "tile_key string, batch long"
    try:
        keys = spark.read.schema(schema).parquet(f"{path}/keys")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "tile_key string")  # nothing rendered yet
    return keys.where(F.col("batch") < before).select("tile_key")


def render_after(
    layer: Layer, z: int, rasters: Callable[[], DataFrame], pixels: Callable[[], DataFrame], path: str,
    catalog: Callable[[], DataFrame | None] | None = None, chunk: tuple[int, int] | None = None,
) -> Callable[[DataFrame, int], None]:
    """An ``after`` hook for ``ingest_stream``: render the tiles new footprints touch.

    A tile shows the granule that the whole ``catalog`` gives for the fresh one's instant, the batch
    included (without a catalog, of the batch alone): one stored before, of the same millisecond and a
    greater id, wins. Tiles already stored under the same content key are skipped. Pixels, keys and traces of a batch
    lie in its own ``batch=`` folder, so a repeated batch replaces its own output.
    """

    def run(granules: DataFrame, batch_id: int) -> None:
        spark = granules.sparkSession
        mine = granules.where(F.col("dataset") == layer.dataset)
        tiles = fresh_tiles(mine, z).select("z", "x", "y", "t_ms")
        merged = catalog() if catalog is not None else None
        known = mine if merged is None else merged
        fresh, traces = render_cached(layer, tiles, known, rasters(), pixels(), stored_keys(spark, path, batch_id), chunk)
        fresh.write.mode("overwrite").parquet(f"{path}/pixels/batch={batch_id}")
        traces.write.mode("overwrite").parquet(f"{path}/traces/batch={batch_id}")
        done = rendered_keys(spark.read.parquet(f"{path}/traces/batch={batch_id}"))
        done.write.mode("overwrite").parquet(f"{path}/keys/batch={batch_id}")

    return run
