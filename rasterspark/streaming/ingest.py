"""Granule arrivals: a watched directory, quarantine, upserts, running extents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources.granules import parse_drop_manifests
from .delta_catalog import DeltaCatalog


def stream_granules(spark: SparkSession, path: str, max_files: int = 1000, lines: bool = False, pattern: str = "*.json") -> DataFrame:
    """Drop manifests as they appear, parsed, with ``arrived_at`` and ``issue``.

    A file is one manifest or, with ``lines``, one manifest per line; ``pattern`` says which names count.

    The file source reads every name once, across restarts, from its checkpoint; staging names
    (dot or underscore) are never listed. ``arrived_at`` is the clock of the micro-batch.
    """
    raw = (
        spark.readStream.option("pathGlobFilter", pattern)
        .option("wholetext", str(not lines).lower())
        .option("maxFilesPerTrigger", max_files)
        .text(path)
        .select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
    )
    return parse_drop_manifests(raw).withColumn("arrived_at", F.current_timestamp())


def split_arrivals(batch: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted granules, quarantined rows with a reason) of one micro-batch."""
    sound = batch.where(F.col("issue").isNull())
    broken = batch.where(F.col("issue").isNotNull()).select("name", "raw", F.col("issue").alias("reason"))
    good, bad = C.validate_granules(sound.drop("issue"), datasets)
    refused = bad.select("name", "raw", F.array_join("issues", "; ").alias("reason"))
    return good.drop("raw"), broken.unionByName(refused)


KEYS = ["dataset", "id"]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The catalog as of its last committed batch; None before the first."""
    return DeltaCatalog(spark, path, KEYS).snapshot()


def ingest_batch(
    datasets: DataFrame, catalog_path: str, quarantine_path: str, after: Callable[[DataFrame, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: quarantine, stamp, commit to the catalog.

    A commit writes the batch's rows and now and then merges segments of like size, so what is written
    follows the batch, not the catalog. A batch that runs again replaces its own quarantine and is not
    committed twice. Of several manifests of one granule in a batch the last by file name counts.
    ``after`` sees the accepted granules once they are in the catalog.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            good, bad = split_arrivals(batch, datasets)
            bad.write.mode("overwrite").parquet(f"{quarantine_path}/v={batch_id}")
            columns = [c for c in good.columns if c not in ("name", "arrived_at")]
            last = good.withColumn("ingested_at", F.col("arrived_at")).groupBy(*KEYS).agg(
                F.max_by(F.struct(*[c for c in columns if c not in KEYS]), F.struct("name", F.to_json(F.struct("bbox", "datetime")))).alias("_g")
            )
            stamped = last.select(*KEYS, "_g.*", F.lit(batch_id).cast("long").alias("version"))
            DeltaCatalog(spark, catalog_path, KEYS).commit(stamped, batch_id)
            if after is not None:
                after(stamped, batch_id)
        finally:
            batch.unpersist()

    return run


def ingest_stream(arrivals: DataFrame, datasets: DataFrame, catalog_path: str, quarantine_path: str, checkpoint: str, after=None):
    """Start ingesting; one pass over what is there (``availableNow``), restartable."""
    return (
        arrivals.writeStream.foreachBatch(ingest_batch(datasets, catalog_path, quarantine_path, after))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def widen_extents(granules: DataFrame) -> DataFrame:
    """Running box and interval per dataset, also on a stream (one state row per dataset)."""
    return granules.groupBy("dataset").agg(
        F.min("datetime").alias("t_start"),
        F.max("datetime").alias("t_end"),
        F.min("bbox.west").alias("west"),
        F.min("bbox.south").alias("south"),
        F.max("bbox.east").alias("east"),
        F.max("bbox.north").alias("north"),
    )


def fresh_tiles(granules: DataFrame, z: int) -> DataFrame:
    """Tiles the new footprints cover at a zoom, with the instant they became current."""
    from ..functions.temporal import instant_ms
    from ..operators.spatial import tiles_for_footprints

    spread = tiles_for_footprints(granules, z)
    return spread.select("dataset", "z", "x", "y", instant_ms("datetime").alias("t_ms")).distinct()
