"""A log given out again in its own time: rows fall due as the clock reaches their time stamps, and wait until then."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Replay:
    """A running replay. ended tells whether the last row has been released."""

    def __init__(self, query: StreamingQuery, told: dict):
        self.query, self._told = query, told

    @property
    def ended(self) -> bool:
        return self._told["released"] is not None and self._told["released"] >= self._told["last"]

    def wait(self, seconds: float) -> bool:
        """Until the last row is released, or so many seconds are over; then the stream is stopped."""
        until = time.time() + seconds
        while not self.ended and self.query.isActive and time.time() < until:
            time.sleep(0.1)
        self.query.stop()
        failed = self.query.exception()
        if failed:
            raise failed
        return self.ended


def replay(log: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, at: str = "ts", speed: float = 1.0) -> Replay:
    """Hands the rows of a log to put(rows, batch) in steps of a second: of each step those whose time (column at, a timestamp) lies within the next `speed` seconds of the log.

    The clock is a stream of ticks whose place is kept in the checkpoint, so a replay that is started again goes on where it
    was; what fell due meanwhile comes at once, and a batch that failed comes again under its number. put writes a batch so that its
    number can come twice (as a folder of that number, overwritten). Each step reads the log between two literal times, so only
    the row groups that hold them. Rows without a time are never released; an empty log releases nothing and has ended.
    """
    if not speed > 0:
        raise ValueError("a replay takes a positive speed")
    kind, micros = log.schema[at].dataType.simpleString(), F.unix_micros(F.col(at).cast("timestamp"))
    first, last = log.agg(F.min(micros), F.max(micros)).first()
    told: dict = {"released": None if first is not None else 0, "last": int((last - first) / (speed * 1e6)) if first is not None else 0}
    # a literal of the column's own type, so that the reader can leave row groups out
    stamp = lambda tick: F.timestamp_micros(F.lit(first + int(tick * speed * 1e6))).cast(kind)

    def release(ticks: DataFrame, batch: int) -> None:
        low, high = ticks.agg(F.min("value"), F.max("value")).first()
        if low is None or first is None:
            return
        # ticks of a batch follow each other without a gap
        if low <= told["last"]:
            put(log.where((F.col(at) >= stamp(low)) & (F.col(at) < stamp(high + 1))), batch)
        told["released"] = high

    clock = log.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    query = clock.writeStream.foreachBatch(release).option("checkpointLocation", checkpoint).trigger(processingTime="250 milliseconds").start()
    return Replay(query, told)
