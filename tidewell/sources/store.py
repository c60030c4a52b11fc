"""Frame files on any file system that Spark reaches, their sink, and a persisted index of them.

A frame is a JSON object on a line of its own.  Reading and writing go through
Spark's text source, so paths may be in any store; a line's byte offset is the
sum of the lengths of the lines before it, taken in two levels over the file's
splits, so large files are read in parallel.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan
from . import hk

SCHEMA = T.StructType([f for f in hk.FRAMES if f.name not in ("filename", "byte_offset")])
BROKEN = "broken"
_PARSED = T.StructType([*SCHEMA, T.StructField(BROKEN, T.StringType())])


def write(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file a task, by recording and in order; a job that fails leaves no file behind that counts."""
    columns = [F.col(f.name) for f in SCHEMA]
    rows = frames.repartitionByRange("filename", "byte_offset").sortWithinPartitions("filename", "byte_offset")
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def _lines(reader, path) -> DataFrame:
    rows = reader.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("blk"), F.col("_metadata.file_size").alias("length"))


def parsed(lines: DataFrame) -> DataFrame:
    """Columns of a frame from its line (column value); `broken` has the text of a line that is no frame."""
    got = F.from_json("value", _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    out = lines.where(F.trim("value") != "").withColumn("frame", got)
    # a line that is JSON but no frame
    broken = F.coalesce(F.col(f"frame.{BROKEN}"), F.when(F.col("frame.hkagg_type").isNull(), F.col("value")))
    return out.select(*[c for c in lines.columns if c != "value"], *[f"frame.{f.name}" for f in SCHEMA], broken.alias(BROKEN))


def with_offsets(lines: DataFrame) -> DataFrame:
    """lines with byte_offset; the rows of a split come in the order of the file."""
    sized = lines.withColumn("size", F.octet_length("value") + F.lit(1).cast("long")).withColumn("place", F.monotonically_increasing_id())
    inside = F.sum("size").over(Window.partitionBy("filename", "blk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    before = scan.carried(sized, ["filename"], {"before": (F.sum("size"), "sum")})
    both = scan.attached(sized.withColumn("inside", inside), before, ["filename", "blk"])
    return both.withColumn("byte_offset", F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).drop("size", "place", "inside", "before")


def read(spark: SparkSession, path: str | list[str], broken: bool = False) -> DataFrame:
    """Frames of the files at a path, as FRAMES; with `broken`, also lines that are no frames, and each file's length."""
    rows = parsed(with_offsets(_lines(spark.read, path)))
    rows = rows.withColumn("byte_offset", F.col("byte_offset").cast("long"))
    if broken:
        return rows.select(*hk.FRAMES.fieldNames(), "length", BROKEN)
    return rows.where(F.col(BROKEN).isNull()).select(*hk.FRAMES.fieldNames())


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Frames of files as they arrive, at most so many files a batch.

    A stream has no order between rows, so byte_offset stays null; frames of one
    recording are told apart by frame_idx.  Lines that are no frames are left out.
    """
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", str(files))
    rows = parsed(_lines(reader, path)).where(F.col(BROKEN).isNull())
    return rows.withColumn("byte_offset", F.lit(None).cast("long")).select(*hk.FRAMES.fieldNames())


class Index:
    """A persisted index of frame files: one row a frame and a block, and what was wrong with a file.

    Every update that finds new or grown files adds a version: tables `files`,
    `frames` and `blocks` of those files only, and last a marker; versions without
    a marker don't count, so an update that dies changes nothing and may be
    repeated.  Of a file that was indexed twice the newest version holds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        found = fs.globStatus(path(f"{self.path}/v*/done")) or []
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in found)

    KINDS = {
        "files": "filename string, length long, frames long, broken long, error string",
        "frames": "filename string, byte_offset long, hkagg_type int, session_id long, prov_id int, timestamp double",
        "blocks": "filename string, byte_offset long, session_id long, prov_id int, block_index int, block_name string, fields array<string>, t0 double, t1 double, count int",
    }

    def _all(self, name: str) -> DataFrame:
        """Rows of all versions with their version."""
        out = None
        for v in self.versions():
            part = self.spark.read.schema(self.KINDS[name]).parquet(f"{self.path}/v{v}/{name}").withColumn("version", F.lit(v))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{self.KINDS[name]}, version int")

    def files(self) -> DataFrame:
        """filename, length, frames, broken (lines that are no frames), error, version."""
        rows = self._all("files")
        newest = rows.groupBy("filename").agg(F.max("version").alias("version"))
        return rows.join(newest, ["filename", "version"])

    def _held(self, name: str) -> DataFrame:
        return self._all(name).join(self.files().select("filename", "version"), ["filename", "version"]).drop("version")

    def frames(self) -> DataFrame:
        return self._held("frames")

    def blocks(self) -> DataFrame:
        return self._held("blocks")

    def pending(self, source: str) -> DataFrame:
        """filename, length of the files that are not indexed as they are now; no file is opened, and empty ones wait."""
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
        there = there.select(F.col("path").alias("filename"), F.col("length"))
        return there.join(self.files().select("filename", "length"), ["filename", "length"], "left_anti")

    def update(self, source: str, at_once: int = 10_000) -> int:
        """Indexes what is pending, in versions of at most so many files; how many files that were."""
        names = sorted(r["filename"] for r in self.pending(source).select("filename").collect())  # Spark lists them on the driver too
        for a in range(0, len(names), at_once):
            self._add(names[a : a + at_once])
        return len(names)

    def _add(self, names: list[str]) -> None:
        at = f"{self.path}/v{max(self.versions(), default=0) + 1}"
        path, fs = self._fs()
        fs.delete(path(at), True)  # of an update that died
        work = f"{self.path}/work-{uuid.uuid4().hex}"
        # samples stay where they are: only what the index holds is written
        rows = read(self.spark, names, broken=True)
        span = lambda b: F.struct(b["block_name"].alias("block_name"), F.map_keys(b["fields"]).alias("fields"), F.element_at(b["t"], 1).alias("t0"), (F.element_at(b["t"], -1) + hk.PAD_SECONDS).alias("t1"), F.size(b["t"]).alias("count"))
        rows.withColumn("blocks", F.transform("blocks", span)).drop("providers").write.parquet(work)
        kept = self.spark.read.parquet(work)
        good = kept.where(F.col(BROKEN).isNull())
        good.select(*[c.split()[0] for c in self.KINDS["frames"].split(", ")]).write.parquet(f"{at}/frames")
        blocks = good.where(F.col("hkagg_type") == hk.DATA).select("filename", "byte_offset", "session_id", "prov_id", F.posexplode("blocks").alias("block_index", "b")).where("b.count > 0")
        blocks.select("filename", "byte_offset", "session_id", "prov_id", "block_index", "b.block_name", "b.fields", "b.t0", "b.t1", "b.count").write.parquet(f"{at}/blocks")
        told = kept.groupBy("filename").agg(F.count_if(F.col(BROKEN).isNull()).alias("frames"), F.count_if(F.col(BROKEN).isNotNull()).alias("broken"), F.min_by(F.struct("byte_offset", BROKEN), F.when(F.col(BROKEN).isNotNull(), F.col("byte_offset"))).alias("first"))
        error = F.when(F.col("broken") > 0, F.concat(F.lit("no frame at byte "), F.col("first.byte_offset").cast("string"), F.lit(": "), F.left(f"first.{BROKEN}", F.lit(80))))
        there = self.spark.read.format("binaryFile").load(names).select(F.col("path").alias("filename"), "length")
        files = there.join(told.withColumn("error", error), "filename", "left").select("filename", "length", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("broken", F.lit(0)).alias("broken"), "error")
        files.write.parquet(f"{at}/files")
        fs.create(path(f"{at}/done")).close()
        fs.delete(path(work), True)
