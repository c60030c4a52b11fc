"""Detector archive: frame index, time-range load, clocks, status and channel numbers."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.runs import each_with

#: Phase of one count.
PHASE = pi / 2**15
CHANNELS_PER_BAND = 512
WRAP = float(1 << 32)
#: Channels and times of a cell that a load lists out at once.
BLOCK_CHANNELS = 1024
BLOCK_TIMES = 1024
#: Channels of a cell that are told for all its times before others.
LIST_CHANNELS = 128
#: Channels that a load sends to every executor at once.
SENT_CHANNELS = 1 << 20
#: Rows of the dense table that a task of a load lists out.
TASK_ROWS = 1 << 22


def file_index(frames: DataFrame) -> DataFrame:
    """One row a file: first start, last stop, most channels, frames (frames: filename, frame_idx, frame_type, start, stop, channels)."""
    return frames.groupBy("filename").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("channels").alias("channels"), F.count("*").alias("frames"))


def pending(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that are not indexed yet."""
    return files.join(index.select("filename").distinct(), "filename", "left_anti")


def select_scans(frames: DataFrame, start: float, end: float) -> DataFrame:
    """Scan frames that touch [start, end)."""
    return frames.where((F.col("frame_type") == "Scan") & (F.col("stop") >= start) & (F.col("start") < end))


def load(samples: DataFrame, channels: DataFrame, start: float, end: float) -> DataFrame:
    """Dense table t, channel, phase of [start, end): channels without a count are 0 (samples: t, channel, counts).

    The table is cut into cells of some times by some channels; a cell is one row until the end, and cells
    are dealt out evenly. Short lists of a cell's channels are told time by time, each in the same order, so a
    writer meets few values that repeat soon: a table that is written takes far less room than its rows.
    """
    part = samples.where((F.col("t") >= start) & (F.col("t") < end))
    n_channels, n_times = channels.count(), part.select(F.count_distinct("t")).first()[0]
    blk = F.pmod(F.xxhash64("channel"), F.lit(-(-n_channels // BLOCK_CHANNELS) or 1)).alias("blk")
    span = F.pmod(F.xxhash64("t"), F.lit(-(-n_times // BLOCK_TIMES) or 1)).alias("span")
    # a channel that is listed twice is in two layers, so a block's list names each once
    listed = channels.select("channel", blk, F.row_number().over(Window.partitionBy("channel").orderBy(F.lit(0))).alias("layer"))
    blocks = listed.groupBy("blk", "layer").agg(F.collect_list(F.struct("channel"))["channel"].alias("all"))
    cut = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(LIST_CHANNELS)), lambda k: F.slice("all", k, LIST_CHANNELS))
    blocks = blocks.select("blk", "layer", cut.alias("lists"))
    spans = part.select("t").distinct().groupBy(span).agg(F.collect_list("t").alias("times"))
    met = part.where("channel is not null").groupBy("t", blk).agg(F.collect_set("channel").alias("have"))
    met = met.groupBy(span, "blk").agg(F.map_from_entries(F.collect_list(F.struct("t", "have"))).alias("met"))
    # only a row for each cell is joined and sent; its rows are listed out where it lies
    cells = each_with(spans, blocks, "blk", -(-SENT_CHANNELS // BLOCK_CHANNELS)).join(met, ["span", "blk"], "left")
    cells = cells.repartition(-(-n_channels * n_times // TASK_ROWS) or 1)
    none = F.array().cast(met.schema["met"].dataType.valueType)
    # each time is looked up by a lambda, a step of its own, so the rows of a list and not of a whole cell are held at once
    at = F.transform("times", lambda t: F.struct(t.alias("t"), F.coalesce(F.try_element_at("met", t), none).alias("have")))
    rest = cells.select("times", "met", F.explode("lists").alias("list")).select("list", F.explode(at).alias("at"))
    rest = rest.select("at.t", F.explode(F.array_except("list", "at.have")).alias("channel"))
    seen = part.join(channels.select("channel"), "channel").select("t", "channel", (F.coalesce("counts", F.lit(0)) * PHASE).alias("phase"))
    return seen.unionByName(rest.withColumn("phase", F.lit(0.0)))


def unwrapped_clock(samples: DataFrame) -> DataFrame:
    """frame, i, t: a 32-bit nanosecond counter made steady, from the frame's start on (samples: frame, i, counter, start).

    Each step down is one wrap.
    """
    order = Window.partitionBy("frame").orderBy("i")
    wraps = F.sum(F.when(F.col("counter") < F.col("before"), WRAP).otherwise(0.0)).over(order)
    first = F.first("counter").over(order)
    return samples.withColumn("before", F.lag("counter").over(order)).select("frame", "i", (F.col("start") + (F.col("counter") + wraps - first) / 1e9).alias("t"))


def even_clock(samples: DataFrame) -> DataFrame:
    """frame, i, t: samples at equal distances from the frame's start to its stop (samples: frame, i, n, start, stop)."""
    step = F.when(F.col("n") > 1, (F.col("stop") - F.col("start")) / (F.col("n") - 1)).otherwise(0.0)
    return samples.select("frame", "i", (F.col("start") + F.col("i") * step).alias("t"))


def status_at(starts: DataFrame, updates: DataFrame, when: float, key: str | None = None) -> DataFrame:
    """Status at a time: the last value of every entry since the last session start (starts: t; updates: t, entry, value).

    With `key`, for every key of both tables.
    """
    keys = [key] if key else []
    begun = starts.where(F.col("t") <= when).groupBy(*keys).agg(F.max("t").alias("since"))
    since = updates.where(F.col("t") <= when)
    since = since.join(begun, keys) if keys else since.join(F.broadcast(begun))  # one row
    return since.where(F.col("t") > F.col("since")).groupBy(*keys, "entry").agg(F.max_by("value", "t").alias("value"), F.max("t").alias("t"))


def status_of_each(starts: DataFrame, updates: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """The last update value of each ask (keys..., t, id) in its session: an as-of join by one ordered pass."""
    rows = asks.select(*keys, "t", F.lit(2).alias("q"), "id", F.lit(None).cast("string").alias("value"))
    rows = rows.unionByName(updates.select(*keys, "t", F.lit(1).alias("q"), F.lit(None).cast("long").alias("id"), "value"))
    rows = rows.unionByName(starts.select(*keys, "t", F.lit(0).alias("q"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("value")))
    order = Window.partitionBy(*keys).orderBy("t", "q")
    told = F.when(F.col("q") < 2, F.struct("q", "value"))
    last = F.last(told, True).over(order)
    return rows.withColumn("told", last).where("q = 2").select(*keys, "id", "t", F.col("told.value").alias("value"))


def parse_status(pairs: DataFrame) -> dict:
    """A folded status (entry, value) with its known entries parsed; one status is small."""
    got = {r["entry"]: r["value"] for r in pairs.collect()}
    numbers = lambda text: [float(v) for v in text.strip("[] ").replace(",", " ").split()]
    out: dict = {"raw": got}
    for name, value in got.items():
        tail = name.rsplit(".", 1)[-1]
        if tail == "channelMask":
            out["mask"] = [int(v) for v in numbers(value)]
            out["inverse"] = {c: k for k, c in enumerate(out["mask"])}
        elif tail in ("filterA", "filterB"):
            out[tail] = numbers(value)
        elif tail == "downsampleFactor":
            out["downsample"] = int(value)
        elif tail == "flux_ramp_max_cnt":
            out["flux_ramp_rate_hz"] = 1e6 * out.get("digitizer_mhz", 614.4) / 2 / (int(value) + 1)
    return out


def tone_frequency(center: Column, subband: Column, channel: Column) -> Column:
    return center + subband + channel


def to_band_channel(absolute: Column) -> tuple[Column, Column]:
    return F.floor(absolute / CHANNELS_PER_BAND).cast("long"), F.pmod(absolute, F.lit(CHANNELS_PER_BAND))


def readout_to_channel(readout: DataFrame, mask: DataFrame) -> DataFrame:
    """readout with band and channel (mask: index, absolute)."""
    band, channel = to_band_channel(F.col("absolute"))
    return readout.join(mask, "index").withColumns({"band": band, "channel": channel}).drop("absolute")


def channel_to_readout(asked: DataFrame, mask: DataFrame) -> DataFrame:
    """asked(band, channel) with its readout index, -1 if it is not streaming."""
    got = asked.withColumn("absolute", F.col("band") * CHANNELS_PER_BAND + F.col("channel")).join(mask, "absolute", "left")
    return got.withColumn("index", F.coalesce("index", F.lit(-1))).drop("absolute")


def to_arrays(samples: DataFrame) -> DataFrame:
    """channel, t, counts as arrays in time order."""
    return samples.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("t", "counts"))).alias("z")).select("channel", F.col("z.t").alias("t"), F.col("z.counts").alias("counts"))
