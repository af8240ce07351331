"""A catalog table that grows by segments: small writes, few reads, one pointer file.

A commit writes its rows as one segment of hash buckets of the key and names it in the pointer. While a
segment is not clearly larger than the next newer one, the two are merged, so sizes at least double from
new to old: a row is rewritten a number of times that grows with the logarithm of the table, and a
snapshot is a few segments. A row of a newer segment hides those of older ones with its key. Only the
pointer, replaced in one step, says what counts; segments it no longer names are deleted some commits
later, when no reader can still be on them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a segment.
BUCKETS = 32
#: Rows a bucket's file should hold at least; smaller segments are written to fewer files.
ROWS_PER_FILE = 50_000
#: A segment is merged with the next newer one unless it has this many times its rows.
GROWTH = 2
#: Commits for which replaced segments stay readable.
KEEP_COMMITS = 8


@dataclass
class Pointer:
    """Named segments from oldest to newest with their row counts, and segments on their way out."""

    last: int = -1
    commits: int = 0
    segments: list[tuple[str, int]] = field(default_factory=list)
    retired: list[tuple[str, int]] = field(default_factory=list)


class DeltaCatalog:
    """Rows with unique ``keys`` below ``path``; a later commit replaces rows of its keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    # --- the pointer ---

    def _hadoop(self, name: str):  # noqa: ANN202 - objects of the JVM
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> Pointer:
        """The state readers see; empty before the first commit."""
        try:
            text = self.spark.read.option("wholetext", "true").text(f"{self.path}/pointer.json").first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return Pointer()
            raise
        state = json.loads(text["value"])
        return Pointer(state["last"], state["commits"], [tuple(s) for s in state["segments"]], [tuple(s) for s in state["retired"]])

    def _point(self, state: Pointer) -> None:
        """Replace the pointer file in one step."""
        jvm, temporary, system = self._hadoop(f"_pointer.{state.commits}.tmp")
        out = system.create(temporary, True)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        _, final, _ = self._hadoop("pointer.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = lambda p: system.makeQualified(p)
        context.rename(qualified(temporary), qualified(final), options)

    # --- segments ---

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("_bucket")

    def _write(self, rows: DataFrame, name: str, count: int) -> None:
        files = max(1, min(BUCKETS, count // ROWS_PER_FILE))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(files)).cast("int")
        dealt = rows.withColumn("_bucket", bucket).repartition(files, "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def _overlaid(self, names: list[str]) -> DataFrame:
        """Rows of segments from oldest to newest, each key's newest row."""
        rows = self._read(names[-1])
        for name in reversed(names[:-1]):
            older = self._read(name).join(rows.select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(older, allowMissingColumns=True)
        return rows

    def snapshot(self) -> DataFrame | None:
        """All rows as of the last commit; None before the first."""
        names = [name for name, _ in self.pointer().segments]
        return self._overlaid(names) if names else None

    # --- commits ---

    def commit(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a batch of rows, each key at most once; a batch that is already in is left alone.

        Gives whether it was added. A batch that died before the pointer named it is written again from
        scratch under the same name.
        """
        state = self.pointer()
        if batch_id <= state.last:
            return False
        name = f"s={batch_id}-{batch_id}"
        rows = rows.persist()
        try:
            count = rows.count()
            if count:
                self._write(rows, name, count)
        finally:
            rows.unpersist()
        segments = [*state.segments, (name, count)] if count else list(state.segments)
        retired = list(state.retired)
        while len(segments) > 1 and segments[-2][1] < GROWTH * segments[-1][1]:
            older, newer = segments[-2][0], segments[-1][0]
            merged = f"s={older[2:].split('-')[0]}-{newer[2:].split('-')[1]}"
            total = self._merge(older, newer, merged, segments[-2][1] + segments[-1][1])
            retired += [(older, state.commits), (newer, state.commits)]
            segments[-2:] = [(merged, total)]
        due = [s for s, since in retired if state.commits - since >= KEEP_COMMITS]
        # a segment written and merged inside this commit was never named, but goes the same way
        kept = [(s, since) for s, since in retired if s not in due]
        self._point(Pointer(batch_id, state.commits + 1, segments, kept))
        for segment in due:
            _, path, system = self._hadoop(segment)
            system.delete(path, True)
        return True

    def _merge(self, older: str, newer: str, merged: str, most: int) -> int:
        self._write(self._overlaid([older, newer]), merged, most)
        return self._read(merged).count()
