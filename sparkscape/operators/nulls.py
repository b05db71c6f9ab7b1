"""Null models: keyed permutations whose ranks are taken over ranges, so no run lies in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscape.session import cut


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "k") -> DataFrame:
    """The rows with their place (from 1) in their group in an order, of which no two rows of a group have the same.

    Rows are sorted by ranges of (group, order); a range's rows are numbered where they lie and
    shifted by the counts of the ranges before it: partitions times groups rows, which are broadcast.
    Group columns aren't null.
    """
    by = [*group, *order]
    s = df.repartitionByRange(*by).sortWithinPartitions(*by)
    r = cut(s.withColumn("pid_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    own = r.groupBy("pid_", *group).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = own.select(*group, F.col("pid_").alias("p2_"), F.col("n_").alias("m_"))
    pairs = own.join(before, group) if group else own.join(before)
    shift = pairs.groupBy("pid_", *group, "first_").agg(F.sum(F.when(F.col("p2_") < F.col("pid_"), F.col("m_")).otherwise(0)).alias("shift_"))
    return r.join(F.broadcast(shift), ["pid_", *group]).withColumn(name, F.col("at_") - F.col("first_") + F.col("shift_") + 1).drop("pid_", "at_", "first_", "shift_")


def key(seed, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), "run", *cols))


def shuffled(cells: DataFrame, ids: list[str], value: str, runs: int, seed=7) -> DataFrame:
    """run, ids, value: the values permuted over the rows in each run, by the order of keyed digests of the ids.

    Ids name a row and aren't null."""
    r = F.broadcast(cells.sparkSession.range(runs).select(F.col("id").alias("run")))  # runs: a given, small number
    places = ranked(cells.select(*ids), [], ids).join(r)
    drawn = ranked(cells.select(*ids, value).join(r).withColumn("d_", key(seed, *ids)).select("run", "d_", value), ["run"], ["d_"])
    return places.join(drawn, ["run", "k"]).select("run", *ids, value)


def judged(runs: DataFrame, statistic: str, observed: DataFrame) -> DataFrame:
    """observed, runs, null_mean, null_sd (sample), z, p_le, p_ge with p = (1 + #) / (1 + runs); observed is one row, one column."""
    name = observed.columns[0]
    x = runs.join(F.broadcast(observed.withColumnRenamed(name, "observed")))  # one row
    g = x.groupBy("observed").agg(F.count("*").alias("runs"), F.round(F.avg(statistic), 6).alias("null_mean"), F.round(F.stddev_samp(statistic), 6).alias("null_sd"), F.count_if(F.col(statistic) <= F.col("observed")).alias("le"), F.count_if(F.col(statistic) >= F.col("observed")).alias("ge"))
    z = F.when(F.col("null_sd") > 0, F.round((F.col("observed") - F.col("null_mean")) / F.col("null_sd"), 3))
    return g.select("observed", "runs", "null_mean", "null_sd", z.alias("z"), F.round((1 + F.col("le")) / (1 + F.col("runs")), 6).alias("p_le"), F.round((1 + F.col("ge")) / (1 + F.col("runs")), 6).alias("p_ge"))
