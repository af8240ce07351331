"""Reading stored blocks by byte range, millions of them in one job, and writing them.

References are cut into segments of a file, and neighbours in a segment merge to one read
(``plan_ranges``). The planned reads are spread over the cluster, so a file with very many references
is read by many tasks, and every byte range is fetched once. Tasks open paths through Arrow's file
systems: local paths, and URIs of any scheme they know (``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``).
For other schemes ``whole_files=True`` lets Spark's own binary reader fetch the files instead.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of a file whose references may share a read.
SEGMENT_BYTES = 8 << 20
#: Unwanted bytes between two blocks that are cheaper to read than to seek over.
MAX_GAP = 64 << 10

# Sample types as little-endian numpy names.
NUMPY_TYPES = {
    "uint8": "<u1",
    "int16": "<i2",
    "uint16": "<u2",
    "int32": "<i4",
    "float32": "<f4",
    "float64": "<f8",
}

_BLOCK = ["asset", "level", "cy", "cx", "h", "w"]
_SCHEMA = "asset string, level int, cy long, cx long, h int, w int, values array<double>, error string"


def _shuffle(data: bytes, width: int) -> bytes:
    """Bytes of equal significance laid together; a ragged tail is kept."""
    whole = len(data) // width * width
    return np.frombuffer(data[:whole], np.uint8).reshape(-1, width).T.tobytes() + data[whole:]


def _unshuffle(data: bytes, width: int) -> bytes:
    """Undo byte shuffling."""
    whole = len(data) // width * width
    planes = np.frombuffer(data[:whole], dtype=np.uint8).reshape(width, -1)
    return planes.T.tobytes() + data[whole:]


def decode_block(raw: bytes, codecs: list[str], dtype: str, samples: int) -> np.ndarray:
    """One stored block to samples: the codec chain in reverse, then a hard size check."""
    kind = np.dtype(NUMPY_TYPES[dtype])
    for codec in reversed(list(codecs)):
        name = codec.split(":", 1)[0]
        if name == "zlib":
            raw = zlib.decompress(raw)
        elif name == "shuffle":
            raw = _unshuffle(raw, kind.itemsize)
        else:
            raise ValueError(f"codec `{name}` is not supported")
    expected = samples * kind.itemsize
    if len(raw) != expected:
        raise ValueError(f"decoded chunk is {len(raw)} bytes, expected {expected}")
    return np.frombuffer(raw, dtype=kind).astype(np.float64)


def encode_block(samples: np.ndarray, codecs: list[str], dtype: str) -> bytes:
    """Samples to stored bytes, the codec chain in order."""
    kind = np.dtype(NUMPY_TYPES[dtype])
    raw = np.ascontiguousarray(samples).astype(kind).tobytes()
    for codec in codecs:
        name, _, level = codec.partition(":")
        if name == "zlib":
            raw = zlib.compress(raw, int(level or 6))
        elif name == "shuffle":
            raw = _shuffle(raw, kind.itemsize)
        else:
            raise ValueError(f"codec `{name}` is not supported")
    return raw


def allocated(refs: DataFrame) -> Column:
    """Whether a reference has bytes at all; sparse blocks have none."""
    return F.col("path").isNotNull() & F.col("offset").isNotNull() & (F.coalesce(F.col("length"), F.lit(0)) > 0)


def plan_ranges(refs: DataFrame, max_gap: int = MAX_GAP, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Reads to make: ``path, start, bytes, blocks``; ``blocks`` are the references one read serves.

    References that begin in one segment of a file and are at most ``max_gap`` bytes apart share a read,
    so a read is a segment and a block long at most. Equal references are read once.
    """
    named = [c for c in (*_BLOCK, "offset", "length", "dtype", "codecs", "nodata") if c in refs.columns]
    keyed = refs.where(allocated(refs)).select("path", F.floor(F.col("offset") / segment).alias("_segment"), F.struct(*named).alias("_ref"))
    parts = keyed.groupBy("path", "_segment").agg(F.array_sort(F.collect_set(F.struct("_ref.offset", "_ref.length", "_ref"))).alias("_refs"))
    # a fold over one segment's references, in order: close the open read where the next block is too far
    kind = parts.schema["_refs"].dataType.elementType["_ref"].dataType.simpleString()
    read = f"struct<start: bigint, stop: bigint, blocks: array<{kind}>>"
    fresh = lambda r: F.struct(r["offset"].cast("long").alias("start"), (r["offset"] + r["length"]).cast("long").alias("stop"), F.array(r["_ref"]).alias("blocks"))

    def add(reads: Column, r: Column) -> Column:
        last = F.element_at(reads, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["stop"], r["offset"] + r["length"]).cast("long").alias("stop"),
            F.concat(last["blocks"], F.array(r["_ref"])).alias("blocks"),
        )
        near = (F.size(reads) > 0) & (r["offset"] <= F.try_element_at(reads, F.lit(-1))["stop"] + max_gap)
        return F.when(near, F.concat(F.slice(reads, 1, F.size(reads) - 1), F.array(joined))).otherwise(F.concat(reads, F.array(fresh(r))))

    folded = parts.select("path", F.explode(F.aggregate("_refs", F.array().cast(f"array<{read}>"), add)).alias("_read"))
    return folded.select("path", F.col("_read.start").alias("start"), (F.col("_read.stop") - F.col("_read.start")).alias("bytes"), F.col("_read.blocks").alias("blocks"))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read_whole(plan: DataFrame, root: str) -> DataFrame:
    """The planned reads with their bytes, cut out of files that Spark's reader fetched."""
    spark = plan.sparkSession
    names = [r["path"] for r in plan.select("path").distinct().toLocalIterator()]
    full = {name: f"{root}/{name}" if root else name for name in names}
    files = spark.read.format("binaryFile").load(list(full.values())).select("path", "content")
    paths = spark.createDataFrame(list(full.items()), "_name string, _full string")
    # the reader normalises a path's scheme, so only what follows it is compared
    tail = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "")
    found = files.join(paths, tail(F.col("path")) == tail(F.col("_full"))).select(F.col("_name").alias("path"), "content")
    cut = F.substring("content", (F.col("start") + 1).cast("int"), F.col("bytes").cast("int"))
    return plan.join(found, "path", "left").select("path", "start", "bytes", "blocks", cut.alias("_raw"))


def read_chunk_refs(refs: DataFrame, root: str = "", max_gap: int = MAX_GAP, whole_files: bool = False) -> DataFrame:
    """Blocks of a table of references.

    ``refs``: ``asset, level, cy, cx, h, w, path, offset, length, dtype, codecs`` and optionally
    ``nodata``. Gives ``asset, level, cy, cx, h, w, values, error``; samples equal to ``nodata``, or NaN,
    are NULL. A block without bytes holds ``nodata`` throughout (0 where there is none). A block that
    cannot be read or decoded has NULL ``values`` and says why. Paths are read under ``root``.
    """
    if "nodata" not in refs.columns:
        refs = refs.withColumn("nodata", F.lit(None).cast("double"))
    plan = plan_ranges(refs, max_gap)
    plan = _read_whole(plan, root) if whole_files else plan.repartition("path", "start").sortWithinPartitions("path", "start")

    def fetch(path: str, start: int, size: int, held: dict) -> bytes:
        full = f"{root}/{path}" if root else path
        if held.get("path") != full:
            if held.get("file"):
                held["file"].close()
            held.clear()
            system, name = _open(full)
            held.update(file=system.open_input_file(name), path=full)
        return held["file"].read_at(size, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        try:
            for batch in batches:
                for read in batch.to_pylist():
                    raw, problem = read.get("_raw"), None
                    if not whole_files:
                        try:
                            raw = fetch(read["path"], read["start"], read["bytes"], held)
                        except OSError as error:
                            held.clear()
                            problem = f"{type(error).__name__}: {error}"
                    elif raw is None:
                        problem = f"FileNotFoundError: {read['path']}"
                    rows, values = [], []
                    for ref in read["blocks"]:
                        error, samples = problem, None
                        if error is None:
                            at = ref["offset"] - read["start"]
                            part = raw[at : at + ref["length"]]
                            try:
                                if len(part) != ref["length"]:
                                    raise ValueError(f"short read: {len(part)} of {ref['length']} bytes")
                                samples = decode_block(part, ref["codecs"] or [], ref["dtype"], ref["h"] * ref["w"])
                            except (ValueError, KeyError, zlib.error) as wrong:
                                error = f"{type(wrong).__name__}: {wrong}"
                        if samples is not None:
                            bad = np.isnan(samples) if ref["nodata"] is None else np.isnan(samples) | (samples == ref["nodata"])
                            samples = pa.array(samples, mask=bad)
                        values.append(samples)
                        rows.append({k: ref[k] for k in _BLOCK} | {"error": error})
                    yield _block_batch(rows, values)
        finally:
            if held.get("file"):
                held["file"].close()

    read = plan.mapInArrow(run, _SCHEMA)
    empty = F.array_repeat(F.when(F.col("nodata").isNull(), F.lit(0.0)), (F.col("h") * F.col("w")).cast("int"))
    sparse = refs.where(~allocated(refs)).select(*_BLOCK, empty.alias("values"), F.lit(None).cast("string").alias("error"))
    kinds = dict(zip(_BLOCK, ("string", "int", "long", "long", "int", "int"), strict=True))
    return read.unionByName(sparse.select(*(F.col(c).cast(t) for c, t in kinds.items()), "values", "error"))


def _block_batch(rows: list[dict], values: list[pa.Array | None]) -> pa.RecordBatch:
    kinds = [("asset", pa.string()), ("level", pa.int32()), ("cy", pa.int64()), ("cx", pa.int64()), ("h", pa.int32()), ("w", pa.int32())]
    sizes = [0 if v is None else len(v) for v in values]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = pa.concat_arrays([v for v in values if v is not None] or [pa.array([], pa.float64())])
    missing = np.array([v is None for v in values] + [False])
    lists = pa.ListArray.from_arrays(pa.array(ends, mask=missing) if missing.any() else pa.array(ends), flat)
    columns = [pa.array([r[n] for r in rows], t) for n, t in kinds]
    return pa.RecordBatch.from_arrays([*columns, lists, pa.array([r["error"] for r in rows], pa.string())], [n for n, _ in kinds] + ["values", "error"])


def write_chunk_files(blocks: DataFrame, folder: str, dtype: str, codecs: list[str], nodata: float | None = None) -> DataFrame:
    """Store blocks (``asset, level, cy, cx, h, w, values``) as binary files; gives their references.

    A task writes one file of the blocks it holds, in order of asset and place, under a name of its own, so
    a repeated task never touches a file that is referred to. NULL samples are stored as ``nodata``. The
    references are stored too, as only they say which files count.
    """
    schema = "asset string, level int, cy long, cx long, h int, w int, path string, offset long, length long, dtype string, codecs array<string>, nodata double"
    fill = float("nan") if nodata is None else float(nodata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, at = f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                samples = np.array([fill if v is None else v for v in r.pop("values")])
                raw = encode_block(samples, codecs, dtype)
                if file is None:
                    system, name = _open(path)
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    file = system.open_output_stream(name)
                file.write(raw)
                r.update(path=path, offset=at, length=len(raw), dtype=dtype, codecs=codecs, nodata=nodata)
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _REF_SCHEMA)
        if file is not None:
            file.close()

    placed = blocks.select(*_BLOCK, "values").repartition("asset", "level").sortWithinPartitions("asset", "level", "cy", "cx")
    kinds = dict(zip(_BLOCK, ("string", "int", "long", "long", "int", "int"), strict=True))
    return cut_lineage(placed.select(*(F.col(c).cast(t) for c, t in kinds.items()), F.col("values").cast("array<double>")).mapInArrow(run, schema))


_REF_SCHEMA = pa.schema([
    ("asset", pa.string()), ("level", pa.int32()), ("cy", pa.int64()), ("cx", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("path", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()), ("dtype", pa.string()), ("codecs", pa.list_(pa.string())), ("nodata", pa.float64()),
])


def trim_edges(pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """Drop the padding of full-size edge blocks: pixels outside the raster's width and height."""
    dims = rasters.select("asset", F.col("width").alias("_w"), F.col("height").alias("_h"))
    return pixels.join(dims, "asset").where((F.col("row") < F.col("_h")) & (F.col("col") < F.col("_w"))).drop("_w", "_h")
