"""What streams did, batch by batch: rows, delays, late frames, state; kept by a listener, so that no job is added."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(windows: DataFrame, name: str, since: Column | None = None) -> DataFrame:
    """windows (error, used_prediction_only, ...) as they are, with figures of each batch told to listeners under that name: rows, errors, predictions, and percentiles of the milliseconds from `since` (a timestamp: when a row came in) to now, if given."""
    rows = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.coalesce("used_prediction_only", F.lit(False))).alias("predictions")]
    if since is not None:
        waited = (F.unix_millis(F.current_timestamp()) - F.unix_millis(since)).cast("double")
        rows.append(F.percentile_approx(waited, [0.5, 0.95, 0.99], 1000).alias("waited_ms"))
    return windows.observe(name, *rows)


@dataclass
class Batch:
    query: str
    number: int
    rows_in: int
    batch_ms: float
    #: Rows behind the watermark, which were dropped; rows of state held after the batch.
    late: int
    state_rows: int
    watermark: str | None
    figures: dict[str, dict] = field(default_factory=dict)

    @property
    def integrity(self) -> str:
        """Whether nothing was lost and no window failed."""
        return "OK" if not self.late and not any(f.get("errors") for f in self.figures.values()) else "DEGRADED"


class Accounts(StreamingQueryListener):
    """Keeps the last `most` batches of the session's streams; batches are few, and rows are never kept."""

    def __init__(self, most: int = 10_000):
        self.batches: list[Batch] = []
        self.most, self._lock, self._begun, self._ended = most, threading.Condition(), 0, 0

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._begun += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = list(p.stateOperators)
        figures = {name: row.asDict(True) for name, row in (p.observedMetrics or {}).items()}
        batch = Batch(str(p.id), p.batchId, int(p.numInputRows), float(p.durationMs.get("triggerExecution", 0)), sum(int(o.numRowsDroppedByWatermark) for o in state), sum(int(o.numRowsTotal) for o in state), (p.eventTime or {}).get("watermark"), figures)
        with self._lock:
            self.batches = [*self.batches, batch][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended += 1
            self._lock.notify_all()

    def wait(self, spark: SparkSession, seconds: float = 30.0) -> bool:
        """Events come a little after what they tell: waits until all streams that began have told their end."""
        with self._lock:
            return self._lock.wait_for(lambda: self._begun and self._ended >= self._begun, seconds)

    def total(self, name: str, figure: str) -> int:
        return sum(int(b.figures[name][figure]) for b in self.batches if name in b.figures)

    def percentiles(self, figure: str, shares: list[float]) -> list[float]:
        """Of a figure over the batches, as batch_ms."""
        values = [getattr(b, figure) for b in self.batches]
        return [float(x) for x in np.quantile(values, shares)] if values else []

