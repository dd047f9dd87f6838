"""Live passes: latest static data as a stream's state, scenes by status, late rematching, sessions, the recorder's health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pelagos.storage import materialise

STATIC = "mmsi long, seen timestamp, name string, callsign string, ship_type int, length_m double"
_FIELDS = ("name", "callsign", "ship_type", "length_m")


def latest_static(stream: DataFrame) -> DataFrame:
    """Per vessel the last known value of each field, as a state that every micro-batch updates; a later message without a field keeps the earlier value."""
    shape = f"{STATIC}, n_messages long"
    kept = "seen timestamp, " + ", ".join(f"{f} {k}" for f, k in (("name", "string"), ("callsign", "string"), ("ship_type", "int"), ("length_m", "double"))) + ", n_messages long, " + ", ".join(f"t_{f} timestamp" for f in _FIELDS)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(("seen", *_FIELDS, "n", *(f"t_{f}" for f in _FIELDS)), state.get, strict=True)) if state.exists else {"seen": None, "n": 0, **dict.fromkeys(_FIELDS), **{f"t_{f}": None for f in _FIELDS}}
        for b in batches:
            for row in b.sort_values("seen").itertuples():
                now["n"] += 1
                now["seen"] = row.seen if now["seen"] is None else max(now["seen"], row.seen)
                for f in _FIELDS:
                    value = getattr(row, f)
                    if not pd.isna(value) and (now[f"t_{f}"] is None or row.seen >= now[f"t_{f}"]):
                        now[f], now[f"t_{f}"] = (int(value) if f == "ship_type" else value), row.seen
        state.update((now["seen"], *(now[f] for f in _FIELDS), now["n"], *(now[f"t_{f}"] for f in _FIELDS)))
        out = pd.DataFrame([[key[0], now["seen"], *(now[f] for f in _FIELDS), now["n"]]], columns=["mmsi", "seen", *_FIELDS, "n_messages"])
        out["ship_type"] = out["ship_type"].astype("Int32")
        yield out

    return stream.groupBy("mmsi").applyInPandasWithState(update, shape, kept, "update", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key by inactivity, closed by the watermark. A session window ends when the gap is reached; the batch operator begins a new one only beyond it."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


#: States of a scene in the status table.
DONE, FAILED, SKIPPED = "done", "failed", "no_reports"


class Cycle:
    """Processes new scenes once each, with a status table as checkpoint: failed ones are tried again up to a number of attempts, scenes without reports wait."""

    def __init__(self, spark: SparkSession, path: str, process: Callable[[str, DataFrame], None], most_attempts: int = 3):
        self.spark, self.path, self.process, self.most = spark, path.rstrip("/"), process, most_attempts

    def status(self) -> DataFrame:
        """(scene_id, status, attempts): the last entry per scene."""
        shape = "scene_id string, status string, attempts int, at timestamp"
        try:
            log = self.spark.read.schema(shape).json(f"{self.path}/status")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "scene_id string, status string, attempts int")
        return log.groupBy("scene_id").agg(F.max_by("status", F.struct("at", "attempts")).alias("status"), F.max("attempts").alias("attempts"))

    def due(self, scenes: DataFrame) -> DataFrame:
        """Scenes (scene_id, at) not done and not failed too often."""
        s = self.status().where((F.col("status") == DONE) | ((F.col("status") == FAILED) & (F.col("attempts") >= self.most)))
        return scenes.join(s.select("scene_id"), "scene_id", "left_anti")

    def run(self, scenes: DataFrame, reports: DataFrame, seconds: int = 1800) -> dict[str, str]:
        """One cycle over the scenes that are due, the oldest first; what became of each. Scenes of a cycle are few; their rows stay distributed."""
        known = {r.scene_id: r.attempts for r in self.status().collect()}
        out = {}
        for scene in self.due(scenes).orderBy("at", "scene_id").collect():
            window = reports.where(F.abs(F.unix_micros("ts") - F.unix_micros(F.lit(scene.at))) <= seconds * 1_000_000)
            tries = known.get(scene.scene_id, 0)
            if window.isEmpty():
                out[scene.scene_id] = SKIPPED
            else:
                tries += 1
                try:
                    self.process(scene.scene_id, window)
                    out[scene.scene_id] = DONE
                except Exception:
                    out[scene.scene_id] = FAILED
            row = [(scene.scene_id, out[scene.scene_id], tries)]
            self.spark.createDataFrame(row, "scene_id string, status string, attempts int").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.path}/status")
        return out


def rematch(scenes: DataFrame, processed: DataFrame, reports: DataFrame, seconds: int = 1800) -> DataFrame:
    """Scenes (scene_id, at) for which reports arrived (received) after they were processed (scene_id, processed): those to pair again, with the number of late reports."""
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    a = scenes.join(processed, "scene_id").withColumn("_s", F.explode(F.sequence(slot("at") - 1, slot("at") + 1)))
    late = a.join(reports.withColumn("_s", slot("ts")), "_s").where((F.abs(F.unix_micros("ts") - F.unix_micros("at")) <= seconds * 1_000_000) & (F.col("received") > F.col("processed")))
    return late.groupBy("scene_id").agg(F.count("*").alias("late"))


def recorder_health(alive: Column, last: Column, started: Column, now: Column, stale_s: float = 600.0, grace_s: float = 180.0) -> Column:
    """Health of a recorder: not running, starting, stale or ok."""
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce(last, started))) / 1_000_000
    young = (F.unix_micros(now) - F.unix_micros(started)) / 1_000_000 < grace_s
    return F.when(~F.coalesce(alive, F.lit(False)), "not_running").when(last.isNull() & F.coalesce(young, F.lit(False)), "starting").when(age.isNull() | (age > stale_s), "stale").otherwise("ok")


def restart_wait_s(streak: Column, since_s: Column, backoff: tuple[float, ...] = (60.0, 300.0, 900.0)) -> Column:
    """Seconds until the next restart: none for the first, then longer for each of a streak."""
    need = F.element_at(F.array(*(F.lit(b) for b in backoff)), F.greatest(F.lit(1), F.least(streak, F.lit(len(backoff)))).cast("int"))
    return F.when((streak <= 0) | since_s.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), need - since_s))


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """An unchanging copy that a request keeps while newer ones are written."""
    return materialise(df, name)
