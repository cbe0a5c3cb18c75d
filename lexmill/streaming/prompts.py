"""Health of prompts as a stream: a state a prompt, timers that bring back what was taken out, state that is forgotten."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexmill.operators.prompts import HEALTH, RETURN_AFTER, Health

OUT = f"prompt_id string, at timestamp, {HEALTH}"
#: Hours after which a prompt without requests is forgotten.
KEPT_HOURS = 24 * 30
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ("status", "total", "good", "bad", "row", "average", "out_at", "recent")


class PromptHealth(StatefulProcessor):
    """Folds a prompt's requests into its health.

    A prompt that is taken out sets a timer for when it may come back, so it does without a request; one that came back or
    was taken out again meanwhile ignores it.  A prompt of which nothing is heard is forgotten by a timer too.
    """

    def __init__(self, kept_hours: int = KEPT_HOURS) -> None:
        self.kept_hours = kept_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "value string, heard double")

    def _load(self) -> tuple[Health, float]:
        h = Health()
        if not self.state.exists():
            return h, 0.0
        value, heard = self.state.get()
        for name, x in zip(_FIELDS, json.loads(value)):
            setattr(h, name, [tuple(r) for r in x] if name == "recent" else x)
        return h, heard

    def _keep(self, h: Health, heard: float) -> None:
        self.state.update((json.dumps([getattr(h, name) for name in _FIELDS]), heard))

    def _row(self, key: tuple, at: float, h: Health) -> pd.DataFrame:
        names = [f.split()[0] for f in OUT.split(", ")]
        return pd.DataFrame([(key[0], pd.Timestamp(at, unit="s"), h.status, h.total, h.good, h.bad, h.row, h.average)], columns=names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        h, heard = self._load()
        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for at, success, seconds in pdf[["at", "success", "seconds"]].itertuples(index=False):
            heard = at.timestamp()
            h.at(heard)
            h.used(heard, bool(success), 0.0 if pd.isna(seconds) else float(seconds))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if h.status == "deactivated":
            self.handle.registerTimer(int((h.out_at + RETURN_AFTER) * 1000))
        self.handle.registerTimer(int((heard + self.kept_hours * 3600) * 1000))
        self._keep(h, heard)
        yield self._row(key, heard, h)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        h, heard = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if now >= heard + self.kept_hours * 3600:
            self.state.clear()
            return
        before = h.status
        h.at(now)
        if h.status != before:
            self._keep(h, heard)
            yield self._row(key, now, h)

    def close(self) -> None:
        pass


def live_health(log: DataFrame, late: str = "1 minute", kept_hours: int = KEPT_HOURS) -> DataFrame:
    """(prompt_id, at, status, ...) of a stream (prompt_id, at timestamp, event_id, success, seconds), a row for each prompt and batch and for each return.

    The last row of a prompt is what ``operators.prompts.health`` gives for the log so far at the watermark.  State needs
    the RocksDB store, which is set here where the session names none.
    """
    spark = log.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = log.withWatermark("at", late).selectExpr("cast(prompt_id AS string) AS prompt_id", "at", "event_id", "success", "cast(seconds AS double) AS seconds")
    return rows.groupBy("prompt_id").transformWithStateInPandas(statefulProcessor=PromptHealth(kept_hours), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
