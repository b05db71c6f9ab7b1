"""Files of a run of a channel: messages, rejected attempts, ticks, decisions, filter records and device logs.

Each is a table of JSON lines in its own folder below the run's, appended to and partitioned by day,
so that a day is written again whole after a lost write and readers of a period open its days only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The files of a run and their columns.
FILES = {
    "channel_messages": "device_id string, device_type string, text string, timestamp timestamp, tick bigint, reloj string, message_id string, written_at_utc timestamp",
    "rejected_attempts": "device_id string, device_type string, reason string, t bigint, timestamp timestamp, tick bigint, reloj string, length bigint, received string",
    "channel_ticks": "tick bigint, t double, reloj string, n_mensajes bigint, con_mensajes boolean, written_at_utc timestamp",
    "device_decisions": "device_id string, tick bigint, decision string, reason string, written_at_utc timestamp",
    "call_filter_records": "device_id string, tick bigint, called boolean, cause string, written_at_utc timestamp",
    "device_log": "device_id string, tick bigint, level string, message string, written_at_utc timestamp",
}


def _checked(name: str) -> str:
    if name not in FILES:
        raise ValueError(f"a run has the files {', '.join(FILES)}")
    return FILES[name]


def append(df: DataFrame, run: str, name: str) -> None:
    """Appends rows to a file of a run; columns that the file has not are left out, absent ones are null.

    The day is that of written_at_utc or timestamp, which is the time of writing where the rows have none.
    """
    columns = [c.strip().split(" ") for c in _checked(name).split(",")]
    have = set(df.columns)
    rows = df.select(*(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns))
    stamp = "written_at_utc" if "written_at_utc" in rows.columns else "timestamp"
    rows = rows.withColumn(stamp, F.coalesce(stamp, F.current_timestamp()))
    rows.withColumn("day", F.date_format(stamp, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(f"{run}/{name}")


def read(spark: SparkSession, run: str, name: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Rows of a file of a run, of days between the given ones (both included); a file not yet written is empty."""
    schema = _checked(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(f"{schema}, day string").json(f"{run}/{name}")
    if first_day is not None:
        df = df.where(F.col("day") >= first_day)
    if last_day is not None:
        df = df.where(F.col("day") <= last_day)
    return df.drop("day")
