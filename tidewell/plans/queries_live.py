"""Streams over the events, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import micros
from ..sources import hk, store
from ..streaming import live
from .common import out, rounded
from .queries_archive import T0, frames
from .queries_tod import STAGES, biquads_sql
from .registry import query


def _events(spark, sf):
    """One detector a user; the event's number is its sample number."""
    e = live.opened(spark, sf, "events.parquet")
    return e.select(F.col("user_id").alias("det"), F.col("event_id").alias("samp"), F.col("value").alias("y"), F.timestamp_micros(micros()).alias("ts"))


@query("select user_id det, (event_id // 500)::bigint blk, count(*)::bigint n, round(avg(value), 9) + 0.0 mean, min(value) low, max(value) high from events group by 1, 2")
def stream_block_stats(spark, sf):
    s = live.drained(live.block_stats(_events(spark, sf), 500), "complete")
    return out(s.select("det", "blk", "n", rounded("mean", 9).alias("mean"), "low", "high"))


@query(
    "with e as (select user_id det, ts, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hour or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end new from events), g as (select *, sum(new) over (partition by det order by ts rows unbounded preceding) k from e) select det, epoch_us(min(ts)) \"start\", count(*)::bigint n from g group by det, k"
)
def stream_sessions(spark, sf):
    s = live.drained(live.sessions(_events(spark, sf), "12 hours", "1 hour"), "complete")
    return out(s.select("det", F.unix_micros(F.col("start")).alias("start"), "n"))


@query("select user_id det, epoch_us(ts) // 86400000000 * 86400000000 \"start\", count(*)::bigint n, round(avg(value), 9) + 0.0 mean from events group by 1, 2")
def stream_window_stats(spark, sf):
    # whole days in UTC, whatever zone the session has
    s = live.drained(live.window_stats(_events(spark, sf), "1 day", "1 hour"), "complete")
    return out(s.select("det", F.unix_micros("start").alias("start"), "n", rounded("mean", 9).alias("mean")))


@query(biquads_sql("select user_id det, event_id samp, row_number() over (partition by user_id order by event_id) - 1 i, round(value * 100)::bigint y from events"))
def stream_filtered(spark, sf):
    """The stateful filter over the stream, by the order of event numbers."""
    s = _events(spark, sf).withColumn("y", F.round(F.col("y") * 100).cast("long")).withColumn("samp", F.col("samp").cast("int"))
    return out(live.drained(live.filtered(s, STAGES)))


def _recorded(spark, sf):
    """A recording for each event type: daily session, status and data frames; sessions of ten days, and on the seventh day of each the provider leaves."""
    kinds = (F.lit(0), F.lit(hk.SESSION)), (F.lit(1), F.lit(hk.STATUS)), (F.lit(2), F.lit(hk.DATA)), (F.lit(3), F.lit(hk.STATUS))
    data = frames(spark, sf).where(F.col("hkagg_type") == hk.DATA).withColumn("day", F.floor((F.col("timestamp") - T0) / 86400))
    rows = data.withColumn("one", F.explode(F.array(*[F.struct(k.alias("place"), t.alias("kind")) for k, t in kinds]))).where("one.place < 3 or pmod(day, 10) = 6")
    told = F.array(F.struct("prov_id", F.substring("filename", 4, 100).alias("description")).cast(hk.PROVIDER))
    none = F.array().cast(hk.FRAMES["providers"].dataType)
    made = {
        "byte_offset": F.col("day") * 1000 + F.col("one.place"),
        "session_id": F.floor(F.col("day") / 10),
        "hkagg_type": F.col("one.kind"),
        "providers": F.when(F.col("one.place") == 1, told).otherwise(none),
        "blocks": F.when(F.col("one.place") == 2, F.col("blocks")).otherwise(F.array().cast(hk.FRAMES["blocks"].dataType)),
    }
    rows = rows.withColumns(made).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in hk.FRAMES])
    end = rows.groupBy("filename").agg((F.max("byte_offset") + 1).alias("byte_offset"))
    return rows.unionByName(end.withColumn("hkagg_type", F.lit(hk.END)), allowMissingColumns=True)


@query(
    f"""with e as (select 'hk_' || event_type filename, event_type provider, epoch_us(ts) / 1e6 t, floor((epoch_us(ts) / 1e6 - {T0}) / 86400)::bigint d from events),
h as (select *, floor(d / 10.0)::bigint session_id, max(case when d % 10 = 6 then 1 else 0 end) over (partition by filename, floor(d / 10.0)) six from e)
select filename, session_id, provider, 'block_' || provider block_name, round(min(t), 6) t0, round(max(t) + 1, 6) t1, count(distinct d)::bigint frames, count(*)::bigint count from h group by filename, session_id, provider, six = 1 and d % 10 > 6"""
)
def stream_session_groups(spark, sf):
    """Groups as they close in a stream of frames that is read file by file."""
    folder = live.shared_folder(spark)
    _recorded(spark, sf).repartitionByRange(3, "byte_offset").sortWithinPartitions("byte_offset").write.parquet(folder)
    frames_ = spark.readStream.schema(hk.FRAMES).option("maxFilesPerTrigger", "8").parquet(folder)
    g = live.drained(live.session_groups(frames_))
    return out(g.select("filename", "session_id", "provider", "block_name", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "frames", "count"))


@query(
    f"with e as (select 'observatory.' || event_type || '.feeds.main' provider, epoch_us(ts) / 1e6 t, floor((epoch_us(ts) / 1e6 - {T0}) / 86400) d, value from events) select provider || '.value' field, count(*)::bigint n, round(min(t), 6) \"first\", round(sum(value::double), 6) total from e group by 1 union all select provider || '.k', count(*)::bigint, round(min(t), 6), null from e group by 1"
)
def hk_frame_files(spark, sf):
    """Frames written as text files of the shared store, indexed in two goes, and read back by stream as samples."""
    folder = live.shared_folder(spark)
    made = frames(spark, sf)
    index = store.Index(spark, f"{folder}/index")
    early = F.col("byte_offset") < 20_000
    store.write(made.where(early), f"{folder}/files/a")
    index.update(f"{folder}/files")
    store.write(made.where(~early), f"{folder}/files/b")
    index.update(f"{folder}/files")
    names = hk.provider_names(store.read(spark, f"{folder}/files/a"))
    live.ingest(store.read_stream(spark, f"{folder}/files/*"), f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = live.ingested(spark, f"{folder}/out").withColumn("number", F.when(F.col("field").endswith(".value"), F.col("v").cast("double")))
    got = rows.groupBy("field").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.sum("number").alias("total"))
    # the index knows each block of each file once
    counted = index.blocks().join(names, ["session_id", "prov_id"]).select("provider", "count", F.explode("fields").alias("name")).groupBy("provider", "name").agg(F.sum("count").alias("n"))
    counted = counted.select(F.concat_ws(".", "provider", "name").alias("field"), "n")
    return out(got.join(counted, ["field", "n"]).select("field", "n", rounded("first").alias("first"), rounded("total").alias("total")))


@query("with e as (select 'hk_' || event_type filename, count(distinct floor((epoch_us(ts) / 1e6 - 1704067200.0) / 86400))::bigint n, count(*)::bigint samples from events group by 1) select filename, n + 1 frames, samples, 1::bigint broken, 0::bigint read_again from e")
def hk_index_files(spark, sf):
    """A recording a file, each with a torn line at its end; the second update reads nothing."""
    folder = live.shared_folder(spark)
    lines = frames(spark, sf).select("filename", "byte_offset", F.to_json(F.struct(*[f.name for f in store.SCHEMA])).alias("value"))
    torn = lines.groupBy("filename").agg(F.lit(1 << 40).alias("byte_offset"), F.lit('{"hkagg_type": 2, "blo').alias("value"))
    lines.unionByName(torn).repartition("filename").sortWithinPartitions("filename", "byte_offset").select("filename", "value").write.partitionBy("filename").option("lineSep", "\n").text(f"{folder}/files")
    index = store.Index(spark, f"{folder}/index")
    index.update(f"{folder}/files")
    again = index.update(f"{folder}/files")
    counts = index.blocks().groupBy("filename").agg(F.sum("count").alias("samples"))
    files = index.files().join(counts, "filename").withColumn("filename", F.regexp_extract("filename", "filename=([^/]*)/", 1))
    return out(files.select("filename", "frames", "samples", "broken", F.lit(again).cast("long").alias("read_again")))
