"""Stream queries: the trajectory read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscape.streaming import channel as X


def source(s, d):
    return X.messages(s, f"{d}/monitor_trajectory.parquet")


def plain(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


QUERIES = {
    "stream_published": lambda s, d: X.drained(X.published(source(s, d)).select("rec_id", "series")),
    "stream_rejected": lambda s, d: X.drained(X.rejected(source(s, d))),
    "stream_dedupe": lambda s, d: X.drained(X.once(source(s, d).where("rec_id is not null")).select("rec_id")),
    "stream_ticks": lambda s, d: plain(X.drained(X.ticks(source(s, d)), "complete"), "tick"),
    "stream_sessions": lambda s, d: plain(X.drained(X.session_counts(source(s, d)), "complete"), "since", "until"),
    "stream_channel": lambda s, d: X.drained(X.evaluated(X.once(source(s, d).where("rec_id is not null")))),
    "stream_panel": lambda s, d: X.drained(X.panel(source(s, d))),
}

SQL = {
    "stream_published": "select rec_id, series from monitor_trajectory where regexp_matches(text, '[^ \\t\\r\\n]')",
    "stream_rejected": "select rec_id, series, case when text is null then 'null' else 'blank' end as reason from monitor_trajectory where not coalesce(regexp_matches(text, '[^ \\t\\r\\n]'), false)",
    "stream_dedupe": "select distinct rec_id from monitor_trajectory where rec_id is not null",
    "stream_ticks": "select date_trunc('hour', ts)::timestamp as tick, count(*) as n from monitor_trajectory where ts is not null group by 1",
    "stream_sessions": "with x as (select device_id, ts, coalesce(ts - lag(ts) over (partition by device_id order by ts) >= interval 30 minutes, true)::int as fresh from monitor_trajectory where device_id is not null and ts is not null), y as (select *, sum(fresh) over (partition by device_id order by ts rows unbounded preceding) as k from x) select device_id, min(ts) as since, max(ts) + interval 30 minutes as until, count(*) as n from y group by device_id, k",
    # Drained in one batch, so that a series comes in the order of t, rec_id.
    "stream_panel": """with x as (select *, json_extract(panel, '$.D_ckm')::double as d, json_extract(panel, '$.fabrication_index')::double as f, coalesce(json_extract(panel, '$.n_rejected_pairs')::bigint, 0) as r from monitor_trajectory where series is not null and rec_id is not null)
select series, rec_id, row_number() over w as n, len(list_distinct(list(device_id) over w)) as n_devices, (sum(r) over w)::double as rejected, case when d is null or f is null then 'UNKNOWN' when d < 0.4 then 'stable' when 1 - f < 0.6 then 'deep' else 'degrading' end as zone from x window w as (partition by series order by t, rec_id, received_at rows unbounded preceding)""",
}
