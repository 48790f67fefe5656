"""The map of vehicles as a stream: the latest position of each, and its removal once it has not been seen for a while."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stopclock.streaming.changes import ROCKSDB

SHOWN = ["vehicle_id", "ts", "route_id", "trip_id", "lat", "lon"]
SCHEMA = "vehicle_id string, ts timestamp, route_id string, trip_id string, lat double, lon double, gone boolean"


def _micros(ts: pd.Series) -> pd.Series:
    return ts.dt.tz_localize(None).astype("datetime64[us]").astype("int64") if ts.dt.tz else ts.astype("datetime64[us]").astype("int64")


#: Vehicles are dealt over so many groups, each with one state.
BUCKETS = 256


class LatestVehicle(StatefulProcessor):
    """State is the instant of the last position shown, of each vehicle of a group. A timer at the earliest of them takes
    vehicles off the map when the watermark, which runs a freshness behind the newest position, comes to them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "vehicle_id string, micros bigint")

    def _timer(self, micros: int) -> int:
        return micros // 1000

    def _held(self) -> dict:
        return dict(self.seen.get()) if self.seen.exists() else {}

    def _hold(self, seen: dict, before: int | None) -> None:
        """Store what is on the map; the timer stands at the earliest instant, `before` is where it stood."""
        after = self._timer(min(seen.values())) if seen else None
        if seen:
            self.seen.put(list(seen.items()))
        else:
            self.seen.clear()
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is not None and before != after:
            self.handle.registerTimer(after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._held()
        before = self._timer(min(seen.values())) if seen else None
        batch = pd.concat(list(rows)).sort_values(SHOWN, kind="stable", na_position="first")
        newest = batch.drop_duplicates("vehicle_id", keep="last")
        instants = dict(zip(newest["vehicle_id"].tolist(), _micros(newest["ts"]).tolist(), strict=True))
        newer = [vehicle not in seen or micros > seen[vehicle] for vehicle, micros in instants.items()]
        if any(newer):
            seen |= {vehicle: micros for (vehicle, micros), new in zip(instants.items(), newer, strict=True) if new}
            self._hold(seen, before)
            yield newest.loc[pd.Series(newer, index=newest.index), SHOWN].assign(gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, fired = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        reached = max(fired, timerValues.getCurrentWatermarkInMs())
        gone = {vehicle: micros for vehicle, micros in seen.items() if self._timer(micros) <= reached}
        self._hold({vehicle: micros for vehicle, micros in seen.items() if vehicle not in gone}, None)
        if gone:
            last = pd.Series(list(gone.values()), dtype="int64").astype("datetime64[us]").dt.tz_localize("UTC")
            none = [None] * len(gone)
            yield pd.DataFrame({"vehicle_id": list(gone), "ts": last, "route_id": none, "trip_id": none, "lat": none, "lon": none, "gone": True})

    def close(self) -> None:
        pass


def vehicle_updates(positions: DataFrame, minutes: int = 15) -> DataFrame:
    """Changes of the map: a row for each vehicle with a newer position, and one with `gone` for each that has not been seen for
    `minutes`. The state holds the vehicles on the map and no others; positions that old when they come are left out."""
    positions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*SHOWN)
    dealt = rows.withWatermark("ts", f"{minutes} minutes").withColumn("_bucket", F.pmod(F.xxhash64("vehicle_id"), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=LatestVehicle(), outputStructType=SCHEMA, outputMode="Update", timeMode="EventTime"
    )


def on_map(updates: DataFrame, order: list[str]) -> DataFrame:
    """The map that all updates leave, the last by `order` counting for each vehicle."""
    last = Window.partitionBy("vehicle_id").orderBy(*[F.desc(c) for c in order])
    return updates.withColumn("_last", F.row_number().over(last)).where("_last = 1 and not gone").select(*SHOWN)
