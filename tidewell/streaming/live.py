"""Streaming twins: block statistics, filters with state, translation and ingest.

All take and give streaming DataFrames; start them with writeStream, or let
`drained` run them over the input that is there.  Batch frames work as well,
which the tests use to hold both against each other.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.iir import Bank, Biquad
from ..operators.reduce import block
from ..sources import hk


def block_stats(samples: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """Statistics of fixed sample blocks; state is one row a block (output mode update or complete)."""
    return samples.withColumn("blk", block(size, shift)).groupBy("det", "blk").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"))


def window_stats(rows: DataFrame, length: str, late: str) -> DataFrame:
    """Tumbling time windows over ts with a watermark; windows are dropped once it has passed them."""
    return rows.withWatermark("ts", late).groupBy("det", F.window("ts", length)).agg(F.count("*").alias("n"), F.avg("y").alias("mean")).select("det", F.col("window.start").alias("start"), "n", "mean")


def sessions(rows: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a provider's samples without a longer gap."""
    return rows.withWatermark("ts", late).groupBy("det", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("det", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def filtered(samples: DataFrame, stages: list[Biquad]) -> DataFrame:
    """det, samp, z: the integer filter, whose delays live in the state of each detector.

    Each batch's samples are taken in order of samp; batches must come in order.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        bank = Bank(stages, [old[2 * k : 2 * k + 2] for k in range(len(stages))] if old else None)
        rows = pd.concat(list(frames)).sort_values("samp")
        out = pd.DataFrame({"det": rows["det"], "samp": rows["samp"], "z": bank.apply(rows["y"].tolist())})
        state.update(([w for pair in bank.state for w in pair],))
        yield out

    return samples.select("det", "samp", "y").groupBy("det").applyInPandasWithState(run, "det long, samp int, z long", "w array<long>", "append", GroupStateTimeout.NoTimeout)


def translated(frames: DataFrame, target: int = 2) -> DataFrame:
    """Stateless, frame by frame."""
    return hk.translate(frames, target)


def ingest(frames: DataFrame, path: str, checkpoint: str):
    """Writes data frames as samples partitioned by folder; the query stops when what is there has been read.

    Providers are told by status frames of the same batch or an earlier one; the
    last description by time holds, as in a batch load.  Every batch writes
    folders of its own number, so one that is done again replaces itself.
    Read them with `ingested`.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = batch.where(F.col("hkagg_type") == hk.STATUS).select("session_id", "timestamp", F.explode("providers").alias("p"))
        told = told.groupBy("session_id", F.col("p.prov_id").alias("prov_id")).agg(F.max("timestamp").alias("timestamp"), F.max_by("p.description", "timestamp").alias("provider"))
        told.write.mode("overwrite").parquet(f"{path}/providers/batch={number}")
        # one row a provider and batch that named it
        names = spark.read.schema(told.schema).parquet(f"{path}/providers").groupBy("session_id", "prov_id").agg(F.max_by("provider", "timestamp").alias("provider"))
        rows = hk.with_folder(hk.samples(batch, names))
        rows.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/samples/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """What `ingest` wrote: field, block_name, t, v, folder."""
    return spark.read.schema("field string, block_name string, t double, v string, batch long, folder int").parquet(f"{path}/samples").drop("batch")


_GROUP = "filename string, session_id long, provider string, block_name string, fields array<string>, t0 double, t1 double, frames long, count long"
_OPEN = "fields array<string>, t0 double, t1 double, frames long, count long"


class _Recording(StatefulProcessor):
    """State of one recording: its session, its providers, and the open group of each of their blocks."""

    def __init__(self, idle: float | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "session_id long")
        self.names = handle.getMapState("names", "prov_id int", "provider string")
        self.groups = handle.getMapState("groups", "prov_id int, block_name string", _OPEN)

    def _flushed(self, filename: str, gone: set[int] | None = None) -> list[tuple]:
        """Groups of some providers (all: None), which are closed and forgotten."""
        session = self.session.get()[0] if self.session.exists() else None
        names = {k[0]: v[0] for k, v in self.names.iterator()}
        gone = set(names) if gone is None else gone
        out = []
        for key, group in [(k, v) for k, v in self.groups.iterator() if k[0] in gone]:
            fields, t0, t1, frames, count = group
            out.append((filename, session, names[key[0]], key[1], list(fields), t0, t1, frames, count))
            self.groups.removeKey(key)
        for prov in gone:
            self.names.removeKey((prov,))
        return out

    def _taken(self, filename: str, f) -> list[tuple]:
        """What one frame closes."""
        out = []
        if f.hkagg_type == hk.SESSION:
            if self.session.exists() and self.session.get()[0] != f.session_id:
                out = self._flushed(filename)
            self.session.update((int(f.session_id),))
        elif f.hkagg_type == hk.STATUS:
            told = {int(p["prov_id"]): p["description"] for p in f.providers}
            known = {k[0] for k in self.names.keys()}
            out = self._flushed(filename, known - set(told))
            for prov in set(told) - known:
                self.names.updateValue((prov,), (told[prov],))
        elif f.hkagg_type == hk.DATA:
            prov = int(f.prov_id)
            if not self.names.containsKey((prov,)):
                raise ValueError(f"data of provider {prov}, which no status frame has named")
            for b in f.spans:
                key = (prov, b["block_name"])
                if self.groups.containsKey(key):
                    fields, t0, _, frames, count = self.groups.getValue(key)
                else:
                    fields, t0, frames, count = list(b["fields"]), b["t0"], 0, 0
                self.groups.updateValue(key, (list(fields), float(t0), float(b["t1"]), int(frames) + 1, int(count) + int(b["count"])))
        elif f.hkagg_type == hk.END:
            out = self._flushed(filename)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for f in pd.concat(list(rows)).sort_values("byte_offset").itertuples():
            out += self._taken(key[0], f)
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._flushed(key[0]))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _GROUP.split(", ")])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_groups(frames: DataFrame, idle: float | None = None) -> DataFrame:
    """Field groups of each recording (filename) as they close: filename, session_id, provider, block_name, fields, t0, t1, frames, count.

    A group of a provider's block closes when a status frame no longer names the
    provider, when a new session begins, at an END frame, and with `idle` when a
    recording gave nothing for so many seconds.  A provider that comes back opens
    new groups.  State holds one row for each open group, and no samples; a
    recording's frames must come in order from batch to batch.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that keeps several states
    span = lambda b: F.struct(b["block_name"].alias("block_name"), F.map_keys(b["fields"]).alias("fields"), F.element_at(b["t"], 1).alias("t0"), (F.element_at(b["t"], -1) + hk.PAD_SECONDS).alias("t1"), F.size(b["t"]).cast("long").alias("count"))
    spans = F.transform(F.filter("blocks", lambda b: F.size(b["t"]) > 0), span)
    light = frames.select("filename", "byte_offset", "hkagg_type", "session_id", "prov_id", "providers", spans.alias("spans"))
    return light.groupBy("filename").transformWithStateInPandas(_Recording(idle), _GROUP, "append", "None" if idle is None else "ProcessingTime")


def opened(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files `name` of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return f"{named}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream until what is there has been read: its rows as a table, in mode `complete` the last state."""
    folder = shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is done again writes the same folder again
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
