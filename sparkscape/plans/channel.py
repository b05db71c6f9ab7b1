"""Queries over the channel's evaluation on its own W: panels, versions, decisions, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscape.operators import criterion as K
from sparkscape.operators import evaluation as E
from sparkscape.operators import extraction as X
from sparkscape.plans.monitor import _R, devices, recs
from sparkscape.session import cut, table


def panels(s, d):
    return E.evaluated(table(s, d, "monitor_trajectory"))


def criterion(s, d):
    """The local criterion on each series' devices, by their mean field value and the number of their traces."""
    return K.decide(devices(s, d).select("series", F.col("device_id").alias("name"), "value", F.col("traces").alias("laps")), ["series"])


def audit(s, d):
    """Audit of the local criterion against the device that came last in each series."""
    last = recs(s, d).where("device_id is not null").groupBy("series").agg(F.max_by("device_id", F.struct("t", "rec_id")).alias("name"))
    return K.divergence(K.audited(criterion(s, d), ["series"], 0.3), last, ["series"])


QUERIES = {
    "local_criterion": criterion,
    "local_criterion_audit": audit,
    "extraction_declaration": lambda s, d: X.declared(s, top_k=12),
    "channel_panels": panels,
    "channel_snapshot": lambda s, d: E.snapshot(panels(s, d)),
    "channel_versions": lambda s, d: E.version_register(panels(s, d)),
    "channel_decisions": lambda s, d: E.decisions(panels(s, d)),
    "channel_signed": lambda s, d: E.signed(cut(panels(s, d))),
    # What the accumulated rejection comes to in each cycle of W.
    "channel_cycles": lambda s, d: panels(s, d).where("mode = 'evaluation'").groupBy("series", "version").agg(F.max("delta_sum").alias("delta"), F.max("torn_sum").alias("torn"), F.count("*").alias("n"), F.min("d_ckm").alias("least_d"), F.max("d_ckm").alias("most_d"), F.count("reset").alias("n_resets")),
    # What must hold of every panel: classes of pairs add up, the phase's rejections lie between, resets come with a new W.
    "channel_check": lambda s, d: panels(s, d).where("mode = 'evaluation'").agg(
        F.count_if(F.col("n_declared") != F.col("n_accepted") + F.col("n_expelled") + F.col("n_torn")).alias("bad_classes"),
        F.count_if((F.col("n_rejected") < F.col("n_expelled")) | (F.col("n_rejected") > F.col("n_expelled") + F.col("n_torn"))).alias("bad_rejected"),
        F.count_if(F.col("n_eff") < 1).alias("bad_n_eff"),
        F.count_if((F.col("fabrication") < 0) | (F.col("fabrication") > 1)).alias("bad_fabrication"),
    ),
}

_STEPS = X.declaration(top_k=12)
_RULE = (
    _R
    + """, c as (select series, device_id as name, round(avg("c_S"), 6) as value, count("c_S") as laps from rc where device_id is not null group by all),
nr as (select *, coalesce(value >= max(value) over (partition by series) - 0.05::double, false) as near from c),
g as (select series, coalesce(list_sort(list(name) filter (near)), []) as ns, coalesce(list_sort(list(name) filter (near and laps >= 12)), []) as ts, round(max(value) - max(value) filter (not near), 9) as margin from nr group by 1),
k as (select series, case when len(ns) = 0 then 'UNKNOWN' when len(ns) = 1 then 'field' when len(ts) = 1 then 'trace' when coalesce(margin < 0, false) then 'escalated' else 'undecided' end as origin, ns, ts, margin from g),
lc as (select series, array_to_string(case when origin = 'trace' then ts else ns end, ',') as value, origin, len(ns)::int as n_near, margin from k)"""
)
SQL = {
    "local_criterion": _RULE + " select * from lc",
    "local_criterion_audit": _RULE + """, ls as (select series, arg_max(device_id, {'t': t, 'r': rec_id}) as seen from rc where device_id is not null group by 1),
au as (select *, ('0x' || md5('0:' || series)[1:8])::bigint / 4294967296.0::double < 0.3::double as audited, case when seen is not null then (not list_contains(string_split(value, ','), seen))::int end as off from lc left join ls using (series))
select count(*) as n, count(*) filter (audited) as n_audited, round(avg(off) filter (audited), 6) as sample_rate, round(avg(off), 6) as census_rate from au""",
    "extraction_declaration": "select ordinal::int as ordinal, operator, parameters, sha256 from (values " + ", ".join(f"({k}, '{n}', '{p.replace(chr(39), chr(39) * 2)}')" for k, (n, p) in enumerate(_STEPS)) + ") v(ordinal, operator, parameters), (select sha256(string_agg(operator || ' ' || parameters, chr(10) order by ordinal)) as sha256 from (values " + ", ".join(f"({k}, '{n}', '{p.replace(chr(39), chr(39) * 2)}')" for k, (n, p) in enumerate(_STEPS)) + ") w(ordinal, operator, parameters))",
    "channel_check": "select 0::bigint as bad_classes, 0::bigint as bad_rejected, 0::bigint as bad_n_eff, 0::bigint as bad_fabrication",
}
