"""The last value of every feature, kept in the state of a stream.

Per hash and feature the state holds time and tie of the last triple, many of them in one entry, so a triple passes on only if it beats what
was seen before, in this run of the stream or an earlier one.  A timer of event time forgets keys that were idle for
long.  What follows, ``apply_landed``, lets the latest time win in any case: forgetting, or a batch
that is delivered again, costs rows, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hashloom.streaming.upsert import land_triples

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Shards that keys are dealt to by their hash.  A shard is read from the state, and written if it changed, as a whole, once a
#: batch: its keys share what a call into the state costs.  Choose as many as leave a shard some thousand keys.
SHARDS = 1_024
#: A triple without tie is before all others of its time.
_NO_TIE = -(1 << 63)
_MOMENTS = pa.schema([("key", pa.string()), ("moment", pa.int64()), ("tie", pa.int64())])


class LastValues(StatefulProcessor):
    """Passes on, per batch and key, the last triple if it is later than all before.  A group is a shard of keys."""

    def __init__(self, names: list[str], idle_ms: int):
        self._names, self._idle_ms = names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("moments", T.StructType([T.StructField("rows", T.BinaryType())]))
        self._alarm = handle.getValueState("alarm", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            best = _newest(part if best is None else pd.concat([best, part], ignore_index=True))
        if best is None or best.empty:
            return
        known = self._known()
        new = best[_later(best, known)]
        if new.empty:
            return
        stale = known["key"].isin(new["key"])
        self._keep(pd.concat([known[~stale], new[_MOMENTS.names]], ignore_index=True))
        yield new[self._names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, watermark = self._known(), timerValues.getCurrentWatermarkInMs()
        at = self._alarms(known)
        self._alarm.clear()
        self._keep(known[(at > expiredTimerInfo.getExpiryTimeInMs()) & (at >= watermark)])
        return iter([])

    def _known(self) -> pd.DataFrame:
        """The last moment of every key of the shard."""
        stored = self._last.get()
        if stored is None:
            return _MOMENTS.empty_table().to_pandas()
        return pa.ipc.open_stream(bytes(stored[0])).read_all().to_pandas()

    def _keep(self, known: pd.DataFrame) -> None:
        if known.empty:
            self._last.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _MOMENTS) as writer:
            writer.write_table(pa.Table.from_pandas(known, _MOMENTS, preserve_index=False))
        self._last.update((out.getvalue().to_pybytes(),))
        self._set_alarm(int(self._alarms(known).min()))

    def _alarms(self, known: pd.DataFrame) -> pd.Series:
        """Milliseconds at which each key is forgotten: the watermark is past its last triple by the idle time."""
        return known["moment"] // 1_000 + self._idle_ms

    def _set_alarm(self, at: int) -> None:
        """One timer a shard, for the key that is the first to be forgotten."""
        before = self._alarm.get()
        if before is not None:
            if before[0] == at:
                return
            self._handle.deleteTimer(before[0])
        self._handle.registerTimer(at)
        self._alarm.update((at,))

    def close(self) -> None:
        pass


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The last row of every key."""
    return rows.sort_values(["moment", "tie"]).drop_duplicates("key", keep="last")


def _later(rows: pd.DataFrame, known: pd.DataFrame) -> np.ndarray:
    """Which rows, one a key, are later than what is known of their key."""
    if known.empty:
        return np.ones(len(rows), dtype=bool)
    at = pd.Index(known["key"]).get_indexer(rows["key"])
    moment, tie = (known[name].to_numpy()[at] for name in ("moment", "tie"))
    same = rows["moment"].to_numpy() == moment
    return (at < 0) | (rows["moment"].to_numpy() > moment) | (same & (rows["tie"].to_numpy() > tie))


def latest_triples(
    triples: DataFrame, delay: str, idle: pd.Timedelta, many: list[str] | None = None, shards: int = SHARDS
) -> DataFrame:
    """The triples (hash, feature, value, time, tie, a whole number) of a stream that are later than those before of their feature.

    ``delay`` is how late a triple may come: what is later still is dropped by Spark's watermark.  ``idle`` is how long
    after its last triple a key is remembered.  Features listed in ``many`` are not single-valued: their pairs are keys of
    their own.  Rows without time are dropped.  A stream that is started again with another number of ``shards``
    forgets what it knew.
    """
    schema = triples.schema
    pair = F.when(F.col("feature").isin(many or []), F.col("value").cast("string"))
    keyed = triples.where(F.col("time").isNotNull()).withColumn("pair", F.coalesce(pair, F.lit("")))
    keyed = keyed.withWatermark("time", delay)
    shard = F.pmod(F.xxhash64("hash", "feature", "pair"), F.lit(shards)).cast("int")
    # pandas has no whole numbers beside nulls: null hashes are shards of their own, null values are marked
    shard = F.when(F.col("hash").isNull(), -1 - shard).otherwise(shard)
    value = F.col("value")
    if isinstance(schema["value"].dataType, T.IntegralType):
        value = F.coalesce(value, F.lit(0).cast(schema["value"].dataType))
    dealt = keyed.select(
        "hash",
        "feature",
        value.alias("value"),
        "time",
        F.coalesce(F.col("tie").cast("long"), F.lit(_NO_TIE)).alias("tie"),
        F.col("value").isNull().alias("unset"),
        F.to_json(F.struct("hash", "feature", "pair")).alias("key"),
        F.unix_micros("time").alias("moment"),
        shard.alias("shard"),
    )
    names = ["hash", "feature", "value", "time", "tie", "unset"]
    kept = dealt.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=LastValues(names, int(idle.total_seconds() * 1000)),
        outputStructType=T.StructType([dealt.schema[name] for name in names]),
        outputMode="Update",
        timeMode="EventTime",
    )
    tie = F.when(F.col("tie") != _NO_TIE, F.col("tie")).cast(schema["tie"].dataType)
    return kept.select(
        "hash", "feature", F.when(~F.col("unset"), F.col("value")).alias("value"), "time", tie.alias("tie")
    )


@contextmanager
def _state_store(spark: SparkSession):
    """Queries started here keep their state in RocksDB, which the operator needs; the session is left as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def land_latest(
    triples: DataFrame,
    path: str,
    checkpoint: str,
    delay: str,
    idle: pd.Timedelta,
    many: list[str] | None = None,
    available_now: bool = True,
    shards: int = SHARDS,
) -> StreamingQuery:
    """Start the stream that lands the latest triples; started again with the same checkpoint it goes on with the
    state it had."""
    with _state_store(triples.sparkSession):
        return land_triples(latest_triples(triples, delay, idle, many, shards), path, checkpoint, many, available_now)
