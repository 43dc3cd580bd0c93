"""Answers of a registry server as rows: a batch Python data source over the whois-style protocol."""

from __future__ import annotations

import re
import socket
from collections.abc import Iterator
from typing import IO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME = re.compile(rb"^A(\d{1,12})\s*$")


class ServerError(RuntimeError):
    pass


def read_frame(stream: IO[bytes], limit: int = 1 << 30) -> bytes | None:
    """The data of one answer; b"" for success without data, None for a key that isn't there. Errors and broken frames raise."""
    head = stream.readline(4096)
    if not head:
        raise ServerError("the server closed the connection")
    if head.startswith(b"C"):
        return b""
    if head.startswith(b"D"):
        return None
    if head.startswith(b"F"):
        raise ServerError(head[1:].decode("latin-1").strip())
    m = FRAME.match(head)
    if not m or int(m[1]) > limit:
        raise ServerError(f"not a frame: {head[:40]!r}")
    data = stream.read(int(m[1]))
    if len(data) != int(m[1]) or not stream.readline(4096).startswith(b"C"):
        raise ServerError("frame cut off")
    return data.rstrip(b"\n")


class Some(InputPartition):
    def __init__(self, queries: list[str]) -> None:
        self.queries = queries


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.host, self.port = options["host"], int(options.get("port", 43))
        self.queries = [q for q in options["queries"].split("\n") if q.strip()]
        self.connections, self.timeout = int(options.get("connections", 4)), float(options.get("timeout", 60))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.connections, len(self.queries)))
        return [Some(self.queries[k::n]) for k in range(n)]

    def read(self, partition: Some) -> Iterator[tuple]:
        """One connection for a partition's queries, all sent ahead of the answers."""
        with socket.create_connection((self.host, self.port), self.timeout) as s, s.makefile("rb") as answers:
            s.sendall(b"!!\n" + b"".join(q.encode() + b"\n" for q in partition.queries))
            for q in partition.queries:
                try:
                    data = read_frame(answers)
                    yield q, None if data is None else data.decode("utf-8", "replace"), None
                except ServerError as e:
                    if "closed" in str(e) or "cut off" in str(e) or "not a frame" in str(e):
                        raise
                    yield q, None, str(e)
            s.sendall(b"!q\n")


class IRRd(DataSource):
    """spark.dataSource.register(IRRd); spark.read.format("irrd").option("host", ...).option("queries", "!gAS1\\n!iAS-X,1").load()"""

    @classmethod
    def name(cls) -> str:
        return "irrd"

    def schema(self) -> str:
        return "query string, answer string, error string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))
