"""Queries over the housekeeping and detector archives, built from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..sources import detector, hk
from .common import TOD, out, rounded, tod
from .registry import query, table

T0 = 1704067200.0  # 2024-01-01


def events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "event_type", "user_id", (model.micros() / 1e6).alias("t"), F.col("value").cast("string").alias("value"), F.get_json_object("props", "$.k").alias("k"))


def frames(spark, sf):
    """Data frames by provider (event type) and day, with a status frame each."""
    day = F.floor((F.col("t") - T0) / 86400).cast("int")
    per = events(spark, sf).withColumn("day", day).groupBy("event_type", "day").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value", "k"))).alias("z"))
    prov = F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(1000)).cast("int")
    block = F.struct(F.concat(F.lit("block_"), "event_type").alias("block_name"), F.col("z.t").alias("t"), F.create_map(F.lit("value"), F.col("z.value"), F.lit("k"), F.col("z.k")).alias("fields"))
    base = per.select(
        F.concat(F.lit("hk_"), "event_type").alias("filename"),
        (F.col("day") * 1000 + 1).cast("long").alias("byte_offset"),
        (F.col("day") + 1).alias("frame_idx"),
        F.lit(hk.DATA).alias("hkagg_type"),
        F.lit(2).alias("hkagg_version"),
        F.lit(7).cast("long").alias("session_id"),
        prov.alias("prov_id"),
        F.col("z")[0]["t"].alias("timestamp"),
        F.array().cast(hk.FRAMES["providers"].dataType).alias("providers"),
        F.array(block.cast(hk.BLOCK)).alias("blocks"),
    )
    status = per.select("event_type").distinct().select(
        F.concat(F.lit("hk_"), "event_type").alias("filename"),
        F.lit(0).cast("long").alias("byte_offset"),
        F.lit(0).alias("frame_idx"),
        F.lit(hk.STATUS).alias("hkagg_type"),
        F.lit(2).alias("hkagg_version"),
        F.lit(7).cast("long").alias("session_id"),
        prov.alias("prov_id"),
        F.lit(T0).alias("timestamp"),
        F.array(F.struct(prov.alias("prov_id"), F.concat(F.lit("observatory."), "event_type", F.lit(".feeds.main")).alias("description")).cast(hk.PROVIDER)).alias("providers"),
        F.array().cast(hk.FRAMES["blocks"].dataType).alias("blocks"),
    )
    return base.unionByName(status)


def _samples(spark, sf):
    f = frames(spark, sf)
    return hk.samples(f, hk.provider_names(f))


LONG = """e as (select event_id, event_type, epoch_us(ts) / 1e6 t, value::varchar value, json_extract_string(props, '$.k') k from events),
s as (select 'observatory.' || event_type || '.feeds.main.' || f field, 'block_' || event_type block_name, t, case when f = 'value' then value else k end v from e, (values ('value'), ('k')) x(f))"""


@query(f"with {LONG} select field, block_name timeline, count(*)::bigint samples, round(min(t), 6) \"first\", round(max(t), 6) \"last\" from s group by 1, 2")
def hk_catalog(spark, sf):
    c = hk.fields(_samples(spark, sf))
    return out(c.select("field", "timeline", "samples", F.round("first", 6).alias("first"), F.round("last", 6).alias("last")))


@query(
    f"with {LONG}, d as (select event_type, floor((t - {T0}) / 86400) d, min(t) t0, max(t) + 1 t1, count(*) n from e group by all) select 'observatory.' || event_type || '.feeds.main' provider, round(min(t0), 6) t0, round(max(t1), 6) t1, count(*)::bigint frames, sum(n)::bigint samples from d group by event_type"
)
def hk_index(spark, sf):
    f = frames(spark, sf)
    g = hk.field_groups(hk.block_index(f), hk.provider_names(f))
    return out(g.select("provider", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "frames", F.col("count").alias("samples")))


@query(f"with {LONG} select field, round(t, 6) t, v::double v from s where field like '%.value' and t >= {T0 + 86400} and t < {T0 + 3 * 86400}")
def hk_get_data(spark, sf):
    rows = _samples(spark, sf)
    names = [f"observatory.{e}.feeds.main.value" for e in ("click", "error", "purchase", "signup", "view")]
    got = hk.typed(hk.get_data(rows, names, T0 + 86400, T0 + 3 * 86400))
    return out(got.select("field", F.round("t", 6).alias("t"), F.col("v_double").alias("v")))


@query(f"with {LONG} select case when field like '%.click.%' then 'clicks' else 'errors' end name, round(t, 6) t, v::double v from s where field in ('observatory.click.feeds.main.value', 'observatory.error.feeds.main.k') and t >= {T0 + 500000} and t < {T0 + 900000}")
def hk_load_range(spark, sf):
    got = hk.load_range(hk.with_folder(_samples(spark, sf)), T0 + 500000, T0 + 900000, {"clicks": "observatory.click.feeds.main.value", "errors": "observatory.error.feeds.main.k"})
    return out(got.select("name", F.round("t", 6).alias("t"), F.col("v").cast("double").alias("v")))


@query(f"with {LONG}, x as (select field, block_name from s group by all) select block_name, array_to_string(list_sort(list(field)), ',') fields from x group by block_name")
def hk_timeline_groups(spark, sf):
    g = hk.timelines(hk.fields(_samples(spark, sf)))
    return out(g.select(F.array_join("lines", ",").alias("block_name"), F.array_join("fields", ",").alias("fields")))


@query(f"with {LONG} select distinct case when field like '%signup%' then 'signup.value' else 'view.main.k' end asked, field from s where field in ('observatory.signup.feeds.main.value', 'observatory.view.feeds.main.k')")
def hk_short_match(spark, sf):
    return out(hk.resolve(hk.fields(_samples(spark, sf)), ["signup.value", "view.main.k"], True))


@query(f"with {LONG}, g as (select field, round(sum(v::double), 3) + 0.0 total, count(*) n from s where t < {T0 + 864000} group by field) select a asked, coalesce(n, 0)::bigint n, coalesce(total, 0) total from (values ('observatory.view.feeds.main.value'), ('observatory.none.feeds.main.value')) x(a) left join g on g.field = a")
def hk_simple(spark, sf):
    asked = spark.createDataFrame([(f"observatory.{e}.feeds.main.value",) * 2 for e in ("view", "none")], "asked string, field string")
    got = hk.simple(_samples(spark, sf), asked, None, T0 + 864000)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out(got.select("asked", F.size("t").cast("long").alias("n"), rounded(total, 3).alias("total")))


@query(f"with {LONG} select distinct field, replace(event_type, '-', '_') agent, 'main' feed, f leaf from e, (values ('value'), ('k')) x(f), lateral (select 'observatory.' || event_type || '.feeds.main.' || f field)")
def hk_tree(spark, sf):
    path = hk.tree_path(F.col("field"))
    c = hk.fields(_samples(spark, sf)).select("field").distinct()
    return out(c.select("field", path[0].alias("agent"), path[1].alias("feed"), path[2].alias("leaf")))


@query(f"with {LONG}, d as (select event_type, floor((t - {T0}) / 86400) d from e group by all) select 'observatory.' || event_type || '.feeds.main' provider, count(*)::bigint frames from d group by event_type")
def hk_provider_report(spark, sf):
    f = frames(spark, sf)
    return out(hk.list_providers(f, hk.provider_names(f)).select("provider", "frames"))


@query(f"with {LONG} select field, count(*)::bigint samples from s group by field")
def hk_field_counts(spark, sf):
    f = frames(spark, sf)
    return out(hk.list_fields(f, hk.provider_names(f)))


@query(
    f"with {LONG}, d as (select event_type, floor((t - {T0}) / 86400) d from e group by all) select (count(*) + (select count(distinct event_type) from e))::bigint frames, 0::bigint session_frames, (select count(distinct event_type) from e)::bigint status_frames, count(*)::bigint data_frames, 1::bigint sessions, 0::bigint time_errors, 0::bigint length_errors, 0::bigint drift_warnings, 0::bigint moved_fields from d"
)
def hk_validate(spark, sf):
    return out(hk.validate(frames(spark, sf)))


@query(f"with {LONG}, d as (select event_type, floor((t - {T0}) / 86400) d from e group by all) select 'hk_' || event_type filename, count(*)::bigint frames, 'block_for_k' block_name, 1::bigint was from d group by event_type")
def hk_translate(spark, sf):
    old = frames(spark, sf).where(F.col("hkagg_type") == hk.DATA)
    none = F.transform("blocks", lambda b: F.struct(F.lit(None).cast("string").alias("block_name"), b["t"].alias("t"), b["fields"].alias("fields")))
    new = hk.translate(old.withColumn("blocks", none).withColumn("hkagg_version", F.lit(1)))
    return out(new.groupBy("filename").agg(F.count("*").alias("frames"), F.max(F.col("blocks")[0]["block_name"]).alias("block_name"), F.max("hkagg_version_orig").alias("was")))


@query("select event_id, epoch_us(ts) / 1e6 a, (epoch_us(ts) / 1000000)::bigint // 86400 * 86400.0::double b from events")
def hk_to_timestamp(spark, sf):
    e = table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out(e.select("event_id", hk.to_seconds(text).alias("a"), hk.to_seconds(F.substring(text, 1, 10)).alias("b")))


@query("select event_id, (((epoch_us(ts) // 1000000) << 28) | ((user_id % 16384) << 14)) session from events")
def hk_session_id(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (model.micros() / 1e6).alias("t"), F.lit("").alias("d"))
    return out(e.select("event_id", hk.session_id(F.col("d"), F.col("t"), F.col("user_id")).alias("session")))


# ---- detector archive ----


@query(
    f"with {TOD}, p as (select det channel, t, round(y * 100)::bigint counts from tod where t >= {T0 + 86400} and t < {T0 + 2 * 86400}), x as (select distinct t from p), c as (select distinct det channel from tod) select round(x.t, 6) t, c.channel::bigint channel, round(coalesce(counts, 0) * pi() / 32768, 9) + 0.0 phase from x cross join c left join p on p.t = x.t and p.channel = c.channel"
)
def det_load(spark, sf):
    # times are whole microseconds: rounded once a sample, not once a row of the dense table
    s = tod(spark, sf).select(F.col("det").alias("channel"), F.round("t", 6).alias("t"), F.round(F.col("y") * 100).cast("long").alias("counts"))
    channels = s.select("channel").distinct()
    got = detector.load(s, channels, T0 + 86400, T0 + 2 * 86400)
    return out(got.select("t", "channel", rounded("phase", 9).alias("phase")))


@query(
    "with e as (select user_id frame, row_number() over (partition by user_id order by ts, event_id) - 1 i, epoch_us(ts) // 100 % 4294967296 c from events), w as (select *, case when c < lag(c) over (partition by frame order by i) then 4294967296 else 0 end up from e) select frame::bigint frame, i::bigint i, (c + sum(up) over (partition by frame order by i) - first_value(c) over (partition by frame order by i))::bigint ticks from w"
)
def det_unwrap_clock(spark, sf):
    """A counter of 100 us cut to 32 bits, made steady again."""
    s = tod(spark, sf)
    count = F.floor(F.round(F.col("t") * 1e6) / 100).cast("long")
    rows = s.select(F.col("det").alias("frame"), F.col("samp").alias("i"), F.lit(100.0).alias("start"), F.pmod(count, F.lit(int(detector.WRAP))).cast("double").alias("counter"))
    got = detector.unwrapped_clock(rows)
    return out(got.select("frame", "i", F.round((F.col("t") - 100) * 1e9).cast("long").alias("ticks")))


@query(f"with {TOD}, c as (select det, max(t) - min(t) b, count(*) n from tod group by det) select tod.det frame, samp i, round(0.0 + samp * ((b - 0.0) / (n - 1)), 4) + 0.0 t from tod join c using (det)")
def det_even_clock(spark, sf):
    s = tod(spark, sf)
    ends = s.groupBy("det").agg(F.lit(0.0).alias("start"), (F.max("t") - F.min("t")).alias("stop"), F.count("*").alias("n"))
    rows = s.select("det", F.col("samp").alias("i")).join(ends, "det").withColumnRenamed("det", "frame")
    return out(detector.even_clock(rows).select("frame", "i", rounded("t", 4).alias("t")))


@query(
    f"with e as (select user_id u, event_type k, epoch_us(ts) / 1e6 t, json_extract_string(props, '$.k') v from events where epoch_us(ts) / 1e6 <= {T0 + 15 * 86400}), b as (select u, max(t) since from e where k = 'signup' group by u) select e.u::bigint u, e.k entry, arg_max(v, t) \"value\" from e join b using (u) where e.t > since and k <> 'signup' group by 1, 2"
)
def det_status_asof(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("entry"), (model.micros() / 1e6).alias("t"), F.get_json_object("props", "$.k").alias("value"))
    got = detector.status_at(e.where("entry = 'signup'"), e.where("entry <> 'signup'"), T0 + 15 * 86400, "u")
    return out(got.select("u", "entry", "value"))


@query(
    """with e as (select user_id u, event_id id, event_type k, ts, json_extract_string(props, '$.k') v from events),
b as (select a.u, a.id, a.ts, max(s.ts) since from e a left join e s on s.u = a.u and s.k = 'signup' and s.ts <= a.ts where a.k = 'purchase' group by all),
w as (select b.u, b.id, arg_max(x.v, x.ts) v from b left join e x on x.u = b.u and x.k = 'view' and x.ts <= b.ts and (since is null or x.ts > since) group by all)
select u::bigint u, id::bigint id, v "value" from w"""
)
def det_status_of_each(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("k"), (model.micros() / 1e6).alias("t"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("id"))
    got = detector.status_of_each(e.where("k = 'signup'").select("u", "t"), e.where("k = 'view'").select("u", "t", "value"), e.where("k = 'purchase'").select("u", "t", "id"), ["u"])
    return out(got.select("u", "id", "value"))


def _mask(spark, sf):
    """One readout channel for each absolute channel that a part has: the smallest."""
    return table(spark, sf, "part").groupBy(F.pmod(F.col("p_partkey") * 7, F.lit(4096)).alias("absolute")).agg(F.min("p_partkey").alias("index")).select("index", "absolute")


@query(
    "with m as (select min(p_partkey) idx, (p_partkey * 7) % 4096 absolute from part group by 2), a as (select s_suppkey % 8 band, (s_suppkey * 3) % 512 channel, s_suppkey k from supplier) select a.k, a.band, a.channel, coalesce(idx, -1)::bigint idx from a left join m on m.absolute = a.band * 512 + a.channel"
)
def det_channel_map(spark, sf):
    mask = _mask(spark, sf)
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.pmod("s_suppkey", F.lit(8)).alias("band"), F.pmod(F.col("s_suppkey") * 3, F.lit(512)).alias("channel"))
    return out(detector.channel_to_readout(asked, mask).select("k", "band", "channel", F.col("index").alias("idx")))


@query("select min(p_partkey) \"index\", ((p_partkey * 7) % 4096 // 512)::bigint band, ((p_partkey * 7) % 512)::bigint channel from part group by 2, 3")
def det_readout_channels(spark, sf):
    mask = _mask(spark, sf)
    return out(detector.readout_to_channel(mask.select("index"), mask))


@query(f"with {TOD} select 'f' || (det % 10) filename, round(min(t), 6) \"start\", round(max(t), 6) \"stop\", max(n)::bigint channels, count(*)::bigint frames from tod join dets using (det) group by 1")
def det_file_index(spark, sf):
    s = tod(spark, sf)
    rows = s.join(model.spine(s), "det").select(F.concat(F.lit("f"), F.col("det") % 10).alias("filename"), F.col("t").alias("start"), F.col("t").alias("stop"), F.col("n").alias("channels"))
    i = detector.file_index(rows)
    return out(i.select("filename", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "channels", "frames"))
