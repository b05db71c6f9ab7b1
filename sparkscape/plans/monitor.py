"""Queries over the monitor's trajectory and the event clock."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkscape.operators import monitor as M
from sparkscape.session import table


def recs(s, d):
    return M.records(table(s, d, "monitor_trajectory"))


def devices(s, d):
    """Mean field value and number of traces of each device of a series."""
    g = recs(s, d).where("device_id is not null").groupBy("series", "device_id")
    return g.agg(F.round(F.avg("c_S"), 6).alias("value"), F.count("c_S").alias("traces"))


def betas(s, d):
    g = recs(s, d).where("device_id is not null").groupBy("device_id").agg(F.avg("fabrication_index").alias("m"))
    return g.select("device_id", F.round(F.when(F.col("m") >= 1e-6, 1 / F.col("m")), 6).alias("beta"))


def ticks(s, d):
    """Seconds of the event clock per hour, silent ones included: gaps are filled, silence is data."""
    e = table(s, d, "events").where("ts is not null").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("tick")).agg(F.count("*").alias("n"))
    ends = e.agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("tick"))
    return every.join(e, "tick", "left").select("tick", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("with_messages"))


def sessions(s, d, gap=1800):
    e = table(s, d, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("seconds"))


def slopes(s, d):
    """Events on a sweep: convergence, risk and collapse from lagged slopes."""
    r = recs(s, d)
    a = F.col("fabrication_index") - F.lag("fabrication_index").over(M.in_order())
    b = F.col("c_S") - F.lag("c_S").over(M.in_order())
    kind = F.when((F.abs(a) < 0.05) & (F.abs(b) < 0.05), "convergence").when((a > 0.5) & (b < 0), "risk").when(b < -0.8, "collapse")
    return r.select("rec_id", kind.alias("event")).where("event is not null")


def audit(s, d):
    """Share of records without a measured distance, and of measured ones beyond the threshold, per mode."""
    g = recs(s, d).groupBy("sampling_mode")
    return g.agg(F.count("*").alias("n"), F.count("D_ckm").alias("n_measured"), F.round(F.try_divide(F.count_if(F.col("D_ckm") > M.D_THRESHOLD), F.count("D_ckm")), 6).alias("rate"))


def rhythm(s, d):
    g = recs(s, d).where("device_id is not null").groupBy("device_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    minutes = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 60e6
    return g.select("device_id", "n", F.round(F.when(F.col("n") > 1, F.try_divide(F.col("n").cast("double"), minutes)), 9).alias("per_minute"))


def own(s, d):
    """Runs of consecutive messages of one device joined (gaps and islands): one row a run."""
    r = recs(s, d).withColumn("new", (~F.col("device_id").eqNullSafe(F.lag("device_id").over(M.in_order()))).cast("int"))
    r = r.withColumn("island", F.sum("new").over(M.in_order()))
    return r.groupBy("series", "island", "device_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def unsigned_diff(s, d):
    """Cycles: versions joined as of each record (the last version at or before it)."""
    r = recs(s, d)
    v = M.versions(r).withColumn("version_of", F.col("rec_id"))
    j = r.join(v, "rec_id", "left")
    return j.select("rec_id", F.last("version_of", ignorenulls=True).over(M.in_order()).alias("version"))


QUERIES = {
    "jsonl_scan": lambda s, d: recs(s, d).select("rec_id", "series", "t", "c_S", "fabrication_index", "D_ckm", "n_rejected_pairs", "sampling_mode"),
    "tolerant_scan": lambda s, d: table(s, d, "monitor_trajectory").select(F.when(F.get_json_object("panel", "$").isNull(), "unparsed").otherwise("ok").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "panel_append": lambda s, d: recs(s, d).select("rec_id", (F.row_number().over(M.in_order()) - 1).alias("place"), F.substring("text", 1, 80).alias("text")),
    "stop_signal": lambda s, d: M.stop_signal(recs(s, d)),
    "should_rebuild": lambda s, d: M.should_rebuild(recs(s, d)).where("rebuild"),
    "zone_alpha": lambda s, d: recs(s, d).select("rec_id", M.zone(F.col("D_ckm"), 1 - F.col("fabrication_index")).alias("zone"), F.round(M.alpha(F.col("D_ckm")), 6).alias("alpha")),
    "beta_device": betas,
    "temp_signal": lambda s, d: betas(s, d).select("device_id", M.temperature(F.col("beta"), F.median("beta").over(Window.partitionBy())).alias("signal")),
    "cycles": lambda s, d: M.baseline(recs(s, d)),
    "w_versions": lambda s, d: M.versions(recs(s, d)),
    "version_asof": unsigned_diff,
    "trust_decide": lambda s, d: M.decide(devices(s, d)),
    "monitor_regulated": lambda s, d: M.regulated(recs(s, d)),
    "audit_divergence": audit,
    "sweep_events": slopes,
    "device_rhythm": rhythm,
    "own_messages": own,
    "tick_log": ticks,
    "session_devices": sessions,
    "since_dedupe": lambda s, d: table(s, d, "monitor_trajectory").where("rec_id is not null and ts >= timestamp_ntz '2024-03-01 00:00:00'").groupBy("rec_id").agg(F.min("received_at").alias("received_at"), F.count("*").alias("deliveries")),
    "critical_devices": lambda s, d: devices(s, d).withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc_nulls_last("value"), "device_id"))).where("k <= 3"),
    "event_windows": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v"),
}

_R = """with l0 as (select rec_id, max({'a': received_at, 'b': series, 'c': t, 'd': device_id, 'e': text, 'f': ts, 'g': panel}) as r from monitor_trajectory where rec_id is not null group by 1),
rc as (select rec_id, r.b as series, r.c as t, r.d as device_id, r.e as text, r.f as ts, (r.g::json ->> '$.c_S')::double as "c_S", (r.g::json ->> '$.fabrication_index')::double as fabrication_index, (r.g::json ->> '$.D_ckm')::double as "D_ckm",
 (r.g::json ->> '$.n_rejected_pairs')::bigint as n_rejected_pairs, r.g::json ->> '$.sampling_mode' as sampling_mode from l0)
"""
_W = " window w as (partition by series order by t, rec_id)"
_DV = ", dv as (select series, device_id, round(avg(\"c_S\"), 6) as value, count(\"c_S\") as traces from rc where device_id is not null group by all)"
_BT = ", bt as (select device_id, round(case when avg(fabrication_index) >= 1e-6 then 1 / avg(fabrication_index) end, 6) as beta from rc where device_id is not null group by 1)"

SQL = {
    "jsonl_scan": _R + 'select rec_id, series, t, "c_S", fabrication_index, "D_ckm", n_rejected_pairs, sampling_mode from rc',
    "tolerant_scan": "select case when panel is null or not json_valid(panel) then 'unparsed' else 'ok' end as kind, count(*) as n from monitor_trajectory group by 1",
    "panel_append": _R + "select rec_id, row_number() over w - 1 as place, text[1:80] as text from rc" + _W,
    "stop_signal": _R + ', q as (select rec_id, fabrication_index - first_value(fabrication_index) over f as fi, "D_ckm" - first_value("D_ckm") over f as dd, count(*) over f as n from rc window f as (partition by series order by t, rec_id rows between 4 preceding and current row)) '
    "select rec_id, round(fi, 4) as fi_trend, round(dd, 4) as d_trend, case when n < 2 then 'STABLE' when fi < -0.05 then 'CONVERGING' when fi > 0.05 and dd > 0.02 then 'DIVERGING' else 'STABLE' end as direction from q",
    "should_rebuild": _R + ', q as (select rec_id, "D_ckm" > lag("D_ckm") over w and lag("D_ckm") over w > lag("D_ckm", 2) over w and lag("D_ckm", 2) over w > lag("D_ckm", 3) over w as rebuild from rc' + _W + ") select * from q where rebuild",
    "zone_alpha": _R + """select rec_id, case when "D_ckm" is null or fabrication_index is null then 'UNKNOWN' when "D_ckm" < 0.4 then 'stable' when 1 - fabrication_index < 0.6 then 'deep' else 'degrading' end as zone, round(case when "D_ckm" is not null then 0.3::double - 0.25::double * least(1, greatest(0, ("D_ckm" - 0.4::double) / 0.6::double)) end, 6) as alpha from rc""",
    "beta_device": _R + _BT + "select * from bt",
    "temp_signal": _R + _BT + ", m as (select *, median(beta) over () as c from bt) select device_id, case when beta is null or c is null then 'UNKNOWN' when beta / c > 2 then 'TOO_COLD' when beta / c < 0.5 then 'TOO_HOT' else 'NOMINAL' end as signal from m",
    "cycles": _R + ', q as (select *, sampling_mode is distinct from lag(sampling_mode) over w as ch from rc' + _W + '), c as (select *, sum(case when ch then 1 else 0 end) over (partition by series order by t, rec_id)::bigint as cycle from q) select rec_id, cycle, first_value("c_S" ignore nulls) over (partition by series, cycle order by t, rec_id) as c0 from c',
    "w_versions": _R + ", q as (select rec_id, series, t, sha256(coalesce(sampling_mode, '?')) as sha from rc), p as (select rec_id, sha, lag(sha) over w as was from q" + _W + ") select rec_id, sha from p where sha is distinct from was",
    "version_asof": _R + ", q as (select rec_id, series, t, coalesce(sampling_mode, '?') as m from rc), p as (select *, case when m is distinct from lag(m) over w then rec_id end as v from q" + _W + ") select rec_id, last_value(v ignore nulls) over (partition by series order by t, rec_id) as version from p",
    "trust_decide": _R + _DV + """, b as (select *, coalesce(value >= max(value) over (partition by series) - 0.05::double, false) as near from dv), g as (select series, list_sort(list(device_id) filter (near)) as nr, list_sort(list(device_id) filter (near and traces >= 2)) as tr from b group by 1)
select series, case when nr is null then '' when len(nr) > 1 and len(tr) = 1 then array_to_string(tr, ',') else array_to_string(nr, ',') end as value, case when nr is null then 'UNKNOWN' when len(nr) = 1 then 'field' when len(tr) = 1 then 'trace' else 'escalated' end as origin from g""",
    "audit_divergence": _R + 'select sampling_mode, count(*) as n, count("D_ckm") as n_measured, round(count(*) filter ("D_ckm" > 0.4) / nullif(count("D_ckm"), 0), 6) as rate from rc group by 1',
    "sweep_events": _R + """, q as (select rec_id, fabrication_index - lag(fabrication_index) over w as a, "c_S" - lag("c_S") over w as b from rc""" + _W + "), k as (select rec_id, case when abs(a) < 0.05 and abs(b) < 0.05 then 'convergence' when a > 0.5 and b < 0 then 'risk' when b < -0.8 then 'collapse' end as event from q) select * from k where event is not null",
    "device_rhythm": _R + "select device_id, count(*) as n, round(case when count(*) > 1 then count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 0) end, 9) as per_minute from rc where device_id is not null group by 1",
    "own_messages": _R + ", q as (select *, case when device_id is distinct from lag(device_id) over w then 1 else 0 end as new from rc" + _W + "), i as (select *, sum(new) over (partition by series order by t, rec_id)::bigint as island from q) select series, island, device_id, count(*) as n, min(t) as first_t, sum(coalesce(length(text), 0))::bigint as chars from i group by all",
    "tick_log": "with e as (select date_trunc('hour', ts)::timestamp as tick, count(*) as n from events where ts is not null group by 1), a as (select unnest(generate_series(min(tick), max(tick), interval 1 hour)) as tick from e) select a.tick, coalesce(n, 0) as n, n is not null as with_messages from a left join e on e.tick = a.tick",
    "session_devices": "with e as (select user_id, event_id, epoch_us(ts) // 1000000 as t from events where user_id is not null and ts is not null), q as (select *, case when coalesce(t - lag(t) over (partition by user_id order by t, event_id) > 1800, true) then 1 else 0 end as new from e), z as (select *, sum(new) over (partition by user_id order by t, event_id)::bigint as session from q) select user_id, session, count(*) as n, max(t) - min(t) as seconds from z group by all",
    "since_dedupe": "select rec_id, min(received_at) as received_at, count(*) as deliveries from monitor_trajectory where rec_id is not null and ts >= timestamp '2024-03-01 00:00:00' group by 1",
    "critical_devices": _R + _DV + ", q as (select *, row_number() over (partition by series order by value desc nulls last, device_id) as k from dv) select * from q where k <= 3",
    "event_windows": "select time_bucket(interval 6 hours, ts) as start, event_type, count(*) as n, round(sum(value), 4) as v from events group by all",
}
