"""Streaming forms: change detection, the temporal filter and minute folding, over files as they arrive.

Readings of a device come to one state; rows of a micro-batch are sorted before they are applied, late ones count as of the last time, and state is
small: a value for each channel, or five numbers. Sinks are Parquet with a checkpoint in the shared folder, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewell.functions.temporal import State, step
from tidewell.sources import adapter as ad

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset (local runs)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors see")
    return (found or "file://" + tempfile.mkdtemp(prefix="tidewell-")).rstrip("/")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return ad.readings_of(stream.withColumn("ts_ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")))


def collected(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Changes(StatefulProcessor):
    """Emits readings that change their channel, at a time that never goes back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("ts_ms", LongType())]))
        self.value = handle.getMapState("value", StructType([StructField("channel", LongType())]), StructType([StructField("energy", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is read and written once a batch; a reading is held against the one before it on its channel."""
        last = self.last.get()[0] if self.last.exists() else -1
        now = pd.concat(rows).sort_values(["ts_ms", "seq"], kind="stable", ignore_index=True)
        now["ts_ms"] = now["ts_ms"].cummax().clip(lower=last).astype("int64")
        now["energy"] = now["energy"].astype("float64")
        channels = now["channel"].unique()
        known = {int(c): self.value.getValue((int(c),))[0] for c in channels if self.value.containsKey((int(c),))}
        before = now.groupby("channel")["energy"].shift()
        first = ~now["channel"].duplicated()
        before[first] = now.loc[first, "channel"].map(lambda c: known.get(int(c))).astype("float64")
        new = first & ~now["channel"].isin(list(known))
        same = (now["energy"] == before) | (now["energy"].isna() & before.isna())
        for r in now[~now["channel"].duplicated(keep="last")].itertuples():
            self.value.updateValue((int(r.channel),), (None if pd.isna(r.energy) else float(r.energy),))
        self.last.update((int(now["ts_ms"].iloc[-1]),))
        out = now[new | ~same]
        yield out.assign(device=key[0])[["device", "channel", "ts_ms", "seq", "energy"]]

    def close(self) -> None:
        pass


class Presence(StatefulProcessor):
    """The temporal filter with confirmation, for each reading."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("ts_ms", LongType()), StructField("probability", DoubleType()), StructField("pending", StringType()), StructField("since_ms", LongType()), StructField("confirmed", StringType()), StructField("held", StringType()), StructField("supported_ms", LongType())]
        self.state = handle.getValueState("state", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = State(*self.state.get()) if self.state.exists() else State()
        out = []
        for r in pd.concat(rows).sort_values(["ts_ms", "seq"]).itertuples():
            state = step(state, int(r.ts_ms), None if pd.isna(r.energy) else float(r.energy))
            out.append((key[0], int(r.seq), state.ts_ms, round(state.probability, 6), state.pending, state.confirmed))
        self.state.update(astuple(state))
        yield pd.DataFrame(out, columns=["device", "seq", "ts_ms", "probability", "state", "confirmed"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    schema = "device long, channel long, ts_ms long, seq long, energy double"
    return stream.groupBy("device").transformWithStateInPandas(Changes(), schema, "Append", "None")


def presence(stream: DataFrame) -> DataFrame:
    schema = "device long, seq long, ts_ms long, probability double, state string, confirmed string"
    return stream.groupBy("device").transformWithStateInPandas(Presence(), schema, "Append", "None")


def folded(stream: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling windows by device and channel; the watermark closes them."""
    timed = stream.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    found = timed.groupBy(F.window("at", width), "device", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("energy").alias("top"))
    return found.select("device", "channel", F.unix_millis("window.start").alias("start_ms"), "n", "top")
