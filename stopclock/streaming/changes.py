"""Change-only filtering as a stateful stream: the last kept prediction per key is the state."""

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stopclock.fixed import CHANGE_THRESHOLD_SECONDS, RETAIN_SERVICE_DAYS
from stopclock.operators.changes import DELAY, KEY, NOTHING, TIME

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def said(rows: pd.DataFrame) -> pd.DataFrame:
    """Kind and value in micros of each prediction, as `operators.changes` defines them."""
    timed, delayed = rows["arrival_time"].notna(), rows["delay_seconds"].notna()
    micros = rows["arrival_time"].astype("datetime64[us, UTC]" if rows["arrival_time"].dt.tz else "datetime64[us]").astype("int64")
    delay = rows["delay_seconds"].fillna(0).astype("int64") * 1_000_000
    kind = timed * TIME + (~timed & delayed) * DELAY
    return pd.DataFrame({"kind": kind, "value": micros.where(timed, delay.where(delayed, 0))})


def kept_places(kinds: list[int], values: list[int], last: tuple[int, int] | None, band: int) -> list[int]:
    """Places of the predictions that leave the band around the one kept before them, or say another kind of thing."""
    places = []
    for place, now in enumerate(zip(kinds, values, strict=True)):
        if last is None or now[0] != last[0] or (now[0] != NOTHING and not last[1] - band < now[1] < last[1] + band):
            places.append(place)
            last = now
    return places


#: The keys of a service day are dealt over so many groups, each with one state.
BUCKETS = 128
#: A key within its group, and the last kept prediction of it.
HELD = ["trip_id", "stop_sequence"]


def _plain(values: pd.Series) -> list:
    """Values as Python has them, nothing in place of a missing one; a whole number is whole beside missing ones too."""
    return [None if missing else int(v) if isinstance(v, float) else v for v, missing in zip(values.tolist(), values.isna(), strict=True)]


class ChangeOnly(StatefulProcessor):
    """Keys come in groups, one day's keys of one bucket: what costs a call costs it once for a group. They close together."""

    def __init__(self, threshold: int, retain_days: int | None, held: str) -> None:
        self.threshold, self.retain_days, self.held = threshold, retain_days, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {(trip, stop): (kind, value) for trip, stop, kind, value in self.last.get()} if self.last.exists() else {}
        fresh = not held
        batch = pd.concat(list(rows)).drop(columns="_bucket", errors="ignore")
        # one order for every run: by key, by observation, then by all that a row says
        by = [*HELD, "observed_at"]
        batch = batch.sort_values([*by, *[c for c in batch.columns if c not in by]], kind="stable", na_position="first")
        what = said(batch)
        kinds, values = what["kind"].tolist(), what["value"].tolist()
        keys = list(zip(*[_plain(batch[c]) for c in HELD], strict=True))
        starts = [i for i, now in enumerate(keys) if i == 0 or now != keys[i - 1]]
        places = []
        for low, high in zip(starts, [*starts[1:], len(keys)], strict=True):
            kept = kept_places(kinds[low:high], values[low:high], held.get(keys[low]), self.threshold * 1_000_000)
            if kept:
                places += [low + place for place in kept]
                held[keys[low]] = kinds[places[-1]], values[places[-1]]
        if places:
            self.last.put([(*one, *last) for one, last in held.items()])
        if fresh:
            self._forget_later(key)
        if places:
            frame = batch.iloc[places].copy()
            frame["delay_seconds"] = frame["delay_seconds"].astype("Int32")
            yield frame

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        what = said(initialState)
        columns = [*[_plain(initialState[c]) for c in HELD], what["kind"].tolist(), what["value"].tolist()]
        self.last.appendList(list(zip(*columns, strict=True)))
        self._forget_later(key)

    def _forget_later(self, key) -> None:
        if self.retain_days is not None and key[0] is not None:
            closes = dt.datetime.combine(key[0], dt.time(), dt.UTC) + dt.timedelta(days=self.retain_days + 1)
            self.handle.registerTimer(int(closes.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _dealt(rows: DataFrame) -> GroupedData:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*HELD), F.lit(BUCKETS))).groupBy("start_date", "_bucket")


def changed_stream(
    predictions: DataFrame,
    threshold: int = CHANGE_THRESHOLD_SECONDS,
    retain_days: int | None = RETAIN_SERVICE_DAYS,
    stored: DataFrame | None = None,
) -> DataFrame:
    """The stream's rows worth storing. State of a service day goes `retain_days` after it closes.

    A key's rows of one micro-batch are ordered by observation; across micro-batches they
    must arrive in order. State rests in RocksDB, so it need not fit in memory; that of the groups with new rows is
    read and written whole.

    `stored` holds predictions written before: the last one of each key is where the state starts. It is read once, by the
    first batch of a new checkpoint; a stream that is started again goes on from its checkpoint and reads no table.
    """
    spark = predictions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = retain_days is not None
    rows = predictions.withWatermark("observed_at", f"{retain_days} days") if timed else predictions
    start = None
    if stored is not None:
        latest = F.max_by(F.struct("arrival_time", "delay_seconds"), "observed_at")
        start = stored.groupBy(*KEY).agg(latest.alias("_l")).select(*KEY, "_l.arrival_time", "_l.delay_seconds")
        start = _dealt(start)
    held = ", ".join(f"{c} {predictions.schema[c].dataType.simpleString()}" for c in HELD)
    return _dealt(rows).transformWithStateInPandas(
        statefulProcessor=ChangeOnly(threshold, retain_days, f"{held}, kind int, value bigint"),
        outputStructType=predictions.schema,
        outputMode="Append",
        timeMode="EventTime" if timed else "None",
        initialState=start,
    )
