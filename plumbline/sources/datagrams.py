"""Lines over UDP as a streaming source, and out again.

A socket is bound on the driver; what has come since the last batch becomes its rows. A line cut at a datagram's end is held until
the rest has come. Datagrams are not kept anywhere else, so a batch that was lost with the driver can't be read again.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class LineBuffer:
    """Puts lines together from chunks of bytes."""

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes) -> list[str]:
        *whole, self.rest = (self.rest + chunk).split(b"\n")
        return [x.decode("ascii", "ignore").strip() for x in whole if x.strip()]


class DatagramSource(DataSource):
    """spark.readStream.format("datagrams").option("host", ...).option("port", ...): columns seq, line."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "seq bigint, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return DatagramReader(self.options.get("host", "127.0.0.1"), int(self.options["port"]))


class DatagramReader(SimpleDataSourceStreamReader):
    def __init__(self, host: str, port: int):
        self.at, self.socket, self.buffer, self.held = (host, port), None, LineBuffer(), {}

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.at)
            self.socket.setblocking(False)
        got: list[str] = []
        while True:
            try:
                got += self.buffer.feed(self.socket.recv(4096))
            except BlockingIOError:
                break
        rows = [(start["seq"] + k, line) for k, line in enumerate(got)]
        self.held[start["seq"]] = rows
        return iter(rows), {"seq": start["seq"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = (r for batch in self.held.values() for r in batch)
        return iter([r for r in rows if start["seq"] <= r[0] < end["seq"]])

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if k >= end["seq"]}


def send_lines(df: DataFrame, host: str, port: int, most_hz: float | None = None) -> None:
    """Sends the column line of a batch, from each partition by a socket of its own; with t (seconds) and most_hz, lines that come sooner after the last one sent than that rate allows are dropped."""

    def send(rows) -> None:
        out, last = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), None
        with out:
            for r in rows:
                if most_hz and last is not None and r["t"] - last < 1 / most_hz:
                    continue
                last = r["t"] if most_hz else None
                out.sendto((r["line"] + "\r\n").encode(), (host, port))

    df.foreachPartition(send)
