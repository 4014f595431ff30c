"""Streaming twins of the billing folds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import billing


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def unique_stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each event id once; ids are remembered for the watermark delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _dump(state: dict) -> str:
    """State as JSON; event ids are not kept, the input stream is already unique."""
    kept = {k: v for k, v in state.items() if k != "seen"}
    return json.dumps({**kept, "paid": sorted(state["paid"])}, default=str)


def _load(text: str) -> dict:
    raw = json.loads(text)
    day = lambda v: date.fromisoformat(v) if v else None
    if raw["sub"]:
        raw["sub"]["until"], raw["sub"]["end"] = day(raw["sub"]["until"]), day(raw["sub"]["end"])
    for event in raw["pending"]:
        event["day"], event["due"] = day(event["day"]), day(event["due"])
    return {**raw, "seen": set(), "paid": set(raw["paid"])}


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = _load(state.get[0]) if state.exists else billing.new_subscription()
    events = [row for frame in frames for row in frame.itertuples(index=False)]
    for row in sorted(events, key=lambda r: (r.ts, r.event_id)):
        event = row._asdict()
        event.pop("ts")
        billing.apply_event(held, event)
    state.update((_dump(held),))
    row = billing.subscription_row(key[0], held)
    names = [part.split()[0] for part in billing.SUBSCRIPTION_SCHEMA.split(",")]
    yield pd.DataFrame([row], columns=names)


def subscription_stream(events: DataFrame) -> DataFrame:
    """Subscription state per profile, updated with every micro-batch.

    Events that arrive before their checkout wait in the state. The input is
    the table `unique_stream` writes, so no event id needs to be remembered here.
    """
    return events.groupBy("perfil").applyInPandasWithState(
        _advance,
        billing.SUBSCRIPTION_SCHEMA,
        "state string",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def latest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Last emitted row per key of an update stream written with its batch id."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "lote")]
    best = F.max_by(F.struct(*rest), "lote").alias("_r")
    return rows.groupBy(key).agg(best).select(key, "_r.*")


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the available input; each batch appends its updates with its id."""

    def append(batch: DataFrame, batch_id: int) -> None:
        out = f"{path}/lote={batch_id}"
        batch.write.mode("overwrite").parquet(out)

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain the available input into parquet files."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
