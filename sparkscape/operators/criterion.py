"""A device's own criterion for where to act: the trust rule with a memory of laps, audited.

A decision goes through four steps, the first that settles it counts: the field (candidates within a
tolerance of the best), the trace (of these, those met in at least ``floor`` laps), escalation (more than one is left
and the margin is below the escalation threshold), a named context (a rule given by the caller). The value is a
set; UNKNOWN is empty. With ``kappa`` 0, the local criterion, nothing is escalated. A fixed share of the decisions is audited, chosen by a keyed digest, not by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscape.operators.landscape import unit

# Fixed values of the local criterion: laps a trace needs, share of decisions audited.
FLOOR, AUDITED = 12, 0.1


def decide(candidates: DataFrame, by: list[str], tolerance: float = 0.05, floor: int = FLOOR, kappa: float = 0.0, context: Column | None = None) -> DataFrame:
    """by, value (sorted names, comma-joined), origin, n_near, margin of each group of candidate rows (by, name, value, laps).

    Null and NaN values are no evidence; a group without any is UNKNOWN with an empty set. ``context`` is a column of the candidates: those
    it is true for are preferred in the last step. Sets are of one group's candidates.
    """
    number = F.when(~F.isnan("value"), F.col("value"))
    c = candidates.withColumn("v_", number).withColumn("k_", F.coalesce(context, F.lit(False)) if context is not None else F.lit(False))
    best = c.groupBy(*by).agg(F.max("v_").alias("best"))
    near = F.coalesce(F.col("v_") >= F.col("best") - tolerance, F.lit(False))
    j = c.join(best, by).withColumn("near_", near).withColumn("traced_", near & (F.coalesce("laps", F.lit(0)) >= floor))
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("name"))))
    g = j.groupBy(*by).agg(names(F.col("near_")).alias("near"), names(F.col("traced_")).alias("traced"), names(F.col("near_") & F.col("k_")).alias("named"), F.max(F.when(~F.col("near_"), F.col("v_"))).alias("next_"), F.max("best").alias("best"))
    margin = F.round(F.col("best") - F.col("next_"), 9)
    one = lambda x: F.size(x) == 1
    origin = (
        F.when(F.size("near") == 0, "UNKNOWN").when(one("near"), "field").when(one("traced"), "trace")
        .when(F.coalesce(margin < kappa, F.lit(False)), "escalated").when(F.size("named") > 0, "context").otherwise("undecided")
    )
    value = F.when(origin == "trace", F.col("traced")).when(origin == "context", F.col("named")).otherwise(F.col("near"))
    return g.select(*by, F.array_join(value, ",").alias("value"), origin.alias("origin"), F.size("near").alias("n_near"), margin.alias("margin"))


def audited(decisions: DataFrame, by: list[str], share: float = AUDITED, seed: int = 0) -> DataFrame:
    """The decisions with ``audited``: a keyed share of them."""
    return decisions.withColumn("audited", unit(F.lit(seed), *by) < share)


def divergence(decisions: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """n, n_audited, sample_rate, census_rate: how often the name observed afterwards (by, name) isn't in the decision's set,
    over the audited ones and over all; null where none was observed."""
    j = decisions.join(observed.select(*by, F.col("name").alias("seen_")).distinct(), by, "left")
    off = (~F.array_contains(F.split("value", ","), F.col("seen_"))).cast("int")
    return j.agg(
        F.count("*").alias("n"), F.count_if("audited").alias("n_audited"), F.round(F.avg(F.when(F.col("audited"), off)), 6).alias("sample_rate"), F.round(F.avg(off), 6).alias("census_rate")
    )
