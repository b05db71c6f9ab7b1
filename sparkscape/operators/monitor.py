"""The monitor's rules over trajectories of panels: windows, zones, thresholds, decisions.

Records are ordered within their series; a series is the unit of state, so windows partition
by series. What wasn't measured is null and stays null: it is never read as 0, and zones and
signals of unmeasured values are 'UNKNOWN'.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the zones and bounds of the regulator's alpha.
D_THRESHOLD, FRAC_MIN = 0.40, 0.60
ALPHA_MIN, ALPHA_MAX, ALPHA_FIXED = 0.05, 0.30, 0.10
FI_TREND, D_TREND = 0.05, 0.02
TOO_COLD, TOO_HOT = 2.0, 0.5

PANEL = "c_S double, fabrication_index double, D_ckm double, n_rejected_pairs bigint, sampling_mode string, G_state struct<D_G:double,n_texts:bigint,mode:string>"


def records(trajectory: DataFrame) -> DataFrame:
    """One row per rec_id (its last delivery) with the panel's scalar members as columns."""
    cols = ["series", "t", "device_id", "text", "ts", "received_at", "panel"]
    last = trajectory.where("rec_id is not null").groupBy("rec_id").agg(F.max(F.struct("received_at", *(c for c in cols if c != "received_at"))).alias("r"))
    r = last.select("rec_id", *(F.col(f"r.{c}").alias(c) for c in cols)).withColumn("p", F.from_json("panel", PANEL))
    return r.select("rec_id", "series", "t", "device_id", "text", "ts", "received_at", "p.c_S", "p.fabrication_index", "p.D_ckm", "p.n_rejected_pairs", "p.sampling_mode", F.col("p.G_state.D_G").alias("D_G"))


def in_order(frame: int | None = None):
    w = Window.partitionBy("series").orderBy("t", "rec_id")
    return w if frame is None else w.rowsBetween(-frame, 0)


def zone(d: Column, frac: Column) -> Column:
    return F.when(d.isNull() | frac.isNull(), "UNKNOWN").when(d < D_THRESHOLD, "stable").when(frac < FRAC_MIN, "deep").otherwise("degrading")


def alpha(d: Column) -> Column:
    """Falls from ALPHA_MAX at the threshold to ALPHA_MIN at 1; null where d is."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - D_THRESHOLD) / (1 - D_THRESHOLD)))
    return F.when(d.isNotNull(), ALPHA_MAX + (ALPHA_MIN - ALPHA_MAX) * ratio)


def temperature(beta: Column, critical: Column) -> Column:
    """Ratio of a collective beta to the critical one."""
    r = beta / critical
    return F.when(beta.isNull() | critical.isNull() | (critical <= 0), "UNKNOWN").when(r > TOO_COLD, "TOO_COLD").when(r < TOO_HOT, "TOO_HOT").otherwise("NOMINAL")


def stop_signal(recs: DataFrame, window: int = 5) -> DataFrame:
    """rec_id, fi_trend, d_trend, direction over the last ``window`` records of the series; fewer than two give STABLE."""
    w = in_order(window - 1)
    fi = F.col("fabrication_index") - F.first("fabrication_index").over(w)
    dd = F.col("D_ckm") - F.first("D_ckm").over(w)
    signal = (fi > FI_TREND) & F.coalesce(dd > D_TREND, F.lit(False))
    direction = F.when(F.count("*").over(w) < 2, "STABLE").when(fi < -FI_TREND, "CONVERGING").when(signal, "DIVERGING").otherwise("STABLE")
    return recs.select("rec_id", F.round(fi, 4).alias("fi_trend"), F.round(dd, 4).alias("d_trend"), direction.alias("direction"))


def should_rebuild(recs: DataFrame, n: int = 3) -> DataFrame:
    """rec_id, rebuild: the last n gradients of D_ckm are all positive (false where one is unknown)."""
    ups = [F.coalesce(F.lag("D_ckm", k).over(in_order()) > F.lag("D_ckm", k + 1).over(in_order()), F.lit(False)) for k in range(n)]
    all_up = ups[0]
    for u in ups[1:]:
        all_up = all_up & u
    return recs.select("rec_id", all_up.alias("rebuild"))


def baseline(recs: DataFrame) -> DataFrame:
    """rec_id, cycle, c0: first measured c_S of each cycle; a cycle is a run of one sampling mode."""
    change = ~F.col("sampling_mode").eqNullSafe(F.lag("sampling_mode").over(in_order()))
    c = recs.withColumn("cycle", F.sum(change.cast("int")).over(in_order()))
    w = Window.partitionBy("series", "cycle").orderBy("t", "rec_id")
    return c.select("rec_id", "cycle", F.first("c_S", ignorenulls=True).over(w).alias("c0"))


def versions(recs: DataFrame) -> DataFrame:
    """rec_id, sha: a row where the state digest differs from the last one of the series."""
    sha = F.sha2(F.concat_ws("|", F.coalesce("sampling_mode", F.lit("?"))), 256)
    r = recs.withColumn("sha", sha)
    return r.withColumn("was", F.lag("sha").over(in_order())).where(~F.col("sha").eqNullSafe(F.col("was"))).select("rec_id", "sha")


def decide(candidates: DataFrame, tolerance: float = 0.05, floor: int = 2) -> DataFrame:
    """series, value, origin: which devices of a series a decision falls on.

    Devices by mean field value: those within the tolerance of the best are kept ('field' if
    one); of several, those with at least ``floor`` traces ('trace' if one is left); otherwise
    the set is escalated. A series without a measured value is UNKNOWN with an empty set.
    Sets are of a series' devices.
    """
    best = F.max("value").over(Window.partitionBy("series"))
    c = candidates.withColumn("best", best).withColumn("near", F.coalesce(F.col("value") >= F.col("best") - tolerance, F.lit(False)))
    g = c.groupBy("series").agg(
        F.array_sort(F.collect_list(F.when(F.col("near"), F.col("device_id")))).alias("near"),
        F.array_sort(F.collect_list(F.when(F.col("near") & (F.col("traces") >= floor), F.col("device_id")))).alias("traced"),
    )
    origin = F.when(F.size("near") == 0, "UNKNOWN").when(F.size("near") == 1, "field").when(F.size("traced") == 1, "trace").otherwise("escalated")
    value = F.when(origin == "trace", F.col("traced")).otherwise(F.col("near"))
    return g.select("series", F.array_join(value, ",").alias("value"), origin.alias("origin"))


def regulated(recs: DataFrame) -> DataFrame:
    """rec_id, state, zone, stopped: the regulator as an ordered fold over each series.

    The accumulated rejection grows by each record's rejected pairs and is compressed by
    alpha where the zone asks for a stop; the next record starts from what is left. Unmeasured
    distances leave the state as it is. State is one number a series, so a series of any
    length streams through its task; all series are spread by key.
    """

    def run(key, batches):
        state = 0.0
        for b in batches:
            ids, ds, ns, cs = (b.column(c).to_pylist() for c in ("rec_id", "D_ckm", "n_rejected_pairs", "frac"))
            out = []
            for i, d, n, f in zip(ids, ds, ns, cs):
                z = "UNKNOWN" if d is None or f is None else "stable" if d < D_THRESHOLD else "deep" if f < FRAC_MIN else "degrading"
                state += n or 0
                stop = z in ("deep", "degrading")
                if stop:
                    state *= ALPHA_MAX + (ALPHA_MIN - ALPHA_MAX) * min(1.0, max(0.0, (d - D_THRESHOLD) / (1 - D_THRESHOLD)))
                out.append((i, round(state, 6), z, stop))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.string(), pa.bool_()))], names=["rec_id", "state", "zone", "stopped"])

    rows = recs.select("series", "t", "rec_id", "D_ckm", "n_rejected_pairs", (1 - F.col("fabrication_index")).alias("frac"))
    ordered = rows.repartition("series").sortWithinPartitions("series", "t", "rec_id")
    return _fold_by(ordered, "series", run, "rec_id bigint, state double, zone string, stopped boolean")


def _fold_by(ordered: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """Feeds runs of equal keys of sorted partitions to ``run``, batch by batch."""

    def whole(batches):
        def pieces():
            for b in batches:
                keys, at = b.column(key).to_pylist(), 0
                for k in range(1, len(keys) + 1):
                    if k == len(keys) or keys[k] != keys[at]:
                        yield keys[at], b.slice(at, k - at)
                        at = k

        from itertools import groupby

        for k, group in groupby(pieces(), key=lambda x: x[0]):
            yield from run(k, (b for _, b in group))

    return ordered.mapInArrow(whole, schema)
