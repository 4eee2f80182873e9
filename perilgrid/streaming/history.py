"""Status history over a stream: each event with the status before it, as the batch operator gives it, from keyed state.

Events may come in any order within the watermark. A case's state holds the events that may still get a predecessor, ordered by
time and id, its last settled status, and nothing else: when the watermark passes an event, no earlier one can come any more, and
the event is given out with its predecessor. Events of one id count once while one of them is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from perilgrid.operators.cases import checked_events

OUTPUT = "id long, inspection_id long, changed_at timestamp, from_status string, to_status string"


class History(StatefulProcessor):
    """One case: ``waiting`` maps (time in microseconds, id) to a status, ``last`` is the status settled last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", "to_status string")
        self.last = handle.getValueState("last", "at long, id long, to_status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled = self.last.get() if self.last.exists() else None
        first = None
        for batch in rows:
            at = batch["changed_at"].astype("datetime64[us]").astype("int64")
            for t, i, status in zip(at.tolist(), batch["id"].tolist(), batch["to_status"].tolist(), strict=True):
                if settled is None or (t, i) > (settled[0], settled[1]):  # what is settled isn't changed by repeats
                    self.waiting.updateValue((t, i), (status,))
                    first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        before = self.last.get()[2] if self.last.exists() else None
        out, held = [], sorted((tuple(k), v[0]) for k, v in self.waiting.iterator())
        for (t, i), status in held:
            if t >= mark:
                self.handle.registerTimer(t // 1000 + 1)
                break
            out.append((i, key[0], t, before, status))
            self.waiting.removeKey((t, i))
            before = status
            self.last.update((t, i, status))
        if not out:
            return iter(())
        frame = pd.DataFrame(out, columns=["id", "inspection_id", "changed_at", "from_status", "to_status"])
        frame["changed_at"] = pd.to_datetime(frame["changed_at"], unit="us")
        return iter([frame])

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(id, inspection_id, changed_at, from_status, to_status) for a stream of events (id, inspection_id, changed_at, to_status),
    each once the watermark has passed it. Unknown statuses fail; rows without time, case or id are left out. Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``), which keeps the state of very many cases on disk."""
    known = checked_events(events).filter("id is not null and inspection_id is not null and changed_at is not null")
    known = known.select(F.col("id").cast("long"), F.col("inspection_id").cast("long"), F.col("changed_at").cast("timestamp"), "to_status")
    known = known.withWatermark("changed_at", late)
    return known.groupBy("inspection_id").transformWithStateInPandas(History(), OUTPUT, outputMode="Append", timeMode="EventTime")
