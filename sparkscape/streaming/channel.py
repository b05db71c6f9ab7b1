"""The message channel as structured streams.

Messages: rec_id, series, t, device_id, text, ts, received_at, panel. Streams read parquet
folders, and the same functions serve a live source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkscape.functions import text as T
from sparkscape.operators import evaluation as E
from sparkscape.operators import monitor as M
from sparkscape.session import shared_dir

MESSAGE = "rec_id bigint, series string, t bigint, device_id string, text string, ts timestamp, received_at timestamp, panel string"
# So that numbers and truth values with nulls stay what they are.
NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.bool_(): pd.BooleanDtype()}
PANEL_OUT = "series string, rec_id bigint, n bigint, n_devices bigint, rejected double, zone string"
PANEL_STATE = "n bigint, devices array<string>, rejected double"


def messages(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may name one file as well as a folder.
    df = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("received_at", F.col("received_at").cast("timestamp"))


def published(stream: DataFrame) -> DataFrame:
    """Messages with a text that isn't blank; the others are ``rejected``."""
    return stream.where(F.coalesce(T.not_blank(F.col("text")), F.lit(False)))


def rejected(stream: DataFrame) -> DataFrame:
    reason = F.when(F.col("text").isNull(), "null").otherwise("blank")
    return stream.where(~F.coalesce(T.not_blank(F.col("text")), F.lit(False))).select("rec_id", "series", reason.alias("reason"))


def once(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """Each rec_id once; a repeat within the watermark is dropped, whatever it says."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rec_id"])


def ticks(stream: DataFrame, width: str = "1 hour", late: str = "10 days") -> DataFrame:
    """Messages in each tick of the channel's clock."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("tick"), "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 days") -> DataFrame:
    """Sessions of each device."""
    s = stream.where("device_id is not null").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "device_id")
    return s.agg(F.count("*").alias("n")).select("device_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def in_order(frames: Iterator[pd.DataFrame]) -> list:
    """The rows of a series in a micro-batch by t (null first), rec_id."""
    return sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (pd.notna(r.t), r.t if pd.notna(r.t) else 0, r.rec_id))


def panel(stream: DataFrame) -> DataFrame:
    """Running panel of each series: messages, devices seen, accumulated rejection and zone.

    State is three values a series (its distinct devices among them), kept by the stream.
    Within a micro-batch records are taken in the order of t, rec_id.
    """
    p = stream.withColumn("p", F.from_json("panel", M.PANEL)).select("series", "t", "rec_id", "device_id", "p.D_ckm", "p.fabrication_index", "p.n_rejected_pairs")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, devices, rejected_ = state.get if state.exists else (0, [], 0.0)
        seen, out = set(devices), []
        for r in in_order(frames):
            n += 1
            if isinstance(r.device_id, str):
                seen.add(r.device_id)
            if pd.notna(r.n_rejected_pairs):
                rejected_ += float(r.n_rejected_pairs)
            known = pd.notna(r.D_ckm) and pd.notna(r.fabrication_index)
            zone = "UNKNOWN" if not known else "stable" if r.D_ckm < M.D_THRESHOLD else "deep" if 1 - r.fabrication_index < M.FRAC_MIN else "degrading"
            out.append((key[0], int(r.rec_id), n, len(seen), rejected_, zone))
        state.update((n, sorted(seen), rejected_))
        yield pd.DataFrame(out, columns=["series", "rec_id", "n", "n_devices", "rejected", "zone"])

    return p.where("series is not null and rec_id is not null").groupBy("series").applyInPandasWithState(step, PANEL_OUT, PANEL_STATE, "append", GroupStateTimeout.NoTimeout)


def evaluated(stream: DataFrame, top_k: int = 12, runs: int = 100, seed: int = 0, system: Column | None = None) -> DataFrame:
    """Panels and rebuild decisions of each series (``evaluation.PANEL``), its channel kept between batches.

    Within a micro-batch messages are taken in the order of t, rec_id; a message that comes later than others
    with a greater t is taken when it comes. The state of a series is its channel: the corpus as term counts, W and
    what was accumulated on it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        channel = E.load(state.get[0]) if state.exists else E.Channel(top_k, runs, seed)
        out = [E.row(key[0], int(r.rec_id), int(r.t) if pd.notna(r.t) else None, channel.message(list(r.words), bool(r.opposes), r.device_id if isinstance(r.device_id, str) else None, bool(r.system))) for r in in_order(frames)]
        state.update((E.dump(channel),))
        table = pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), E.TYPES)], names=E.NAMES)
        yield table.to_pandas(types_mapper=NULLABLE.get)

    return E.messages(stream, system).groupBy("series").applyInPandasWithState(step, E.PANEL, "channel binary", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds and returns the rows it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*")
