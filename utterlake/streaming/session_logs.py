"""A stream of session logs: text files of JSON lines that grow while sessions last. A file in a folder ``session=<id>`` is
of that session; a file outside of these is of many, and its lines name theirs. Files, sizes and offsets pass through the
driver, so services with very many sessions log many to a file.

An offset is how many bytes of each file have been read, always whole lines, so a run that is killed reads the same lines
again. The driver sees file names and sizes; a micro-batch is a task for every ``max_bytes`` or so, of one file or of many.
The folder must be mounted on all machines, as services write to it by other means than Spark.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FRAMES = "session long, seq long, ts timestamp, p double"


@dataclass
class Stretches(InputPartition):
    """What a task reads: (path, session or None, start, end) of some stretches."""

    parts: list[tuple[str, int | None, int, int]]


class SessionLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SessionReader(self.options["path"], int(self.options.get("max_bytes", 8 << 20)))


class SessionReader(DataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int):
        self._path, self._max = path.removeprefix("file:"), max_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the last whole line of every file."""
        found = {}
        for folder, inner, names in os.walk(self._path):
            inner[:] = [name for name in inner if name[0] not in "._"]  # what is not written yet
            if folder != self._path and "session=" not in os.path.basename(folder):
                continue
            for name in names:
                if name[0] not in "._":
                    end = self._whole(os.path.join(folder, name))
                    if end:
                        found[os.path.relpath(os.path.join(folder, name), self._path)] = end
        return found

    @staticmethod
    def _whole(path: str, step: int = 1 << 16) -> int:
        with open(path, "rb") as file:
            end = file.seek(0, os.SEEK_END)
            while end > 0:
                start = max(0, end - step)
                file.seek(start)
                at = file.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        out, size = [], 0
        for name, last in sorted(end.items()):
            folder, first = os.path.basename(os.path.dirname(name)), start.get(name, 0)
            session = int(folder.removeprefix("session=")) if folder else None
            for at in range(first, last, self._max):
                until = min(at + self._max, last)
                if not out or size + until - at > self._max or len(out[-1].parts) >= 256:
                    out.append(Stretches([]))
                    size = 0
                out[-1].parts.append((os.path.join(self._path, name), session, at, until))
                size += until - at
        return out

    def read(self, partition: Stretches) -> Iterator[tuple]:
        """The lines that begin within the stretches."""
        for path, session, start, end in partition.parts:
            with open(path, "rb") as file:
                file.seek(max(0, start - 1))
                if start:
                    file.readline()  # up to the first line that begins here
                while file.tell() < end:
                    row = json.loads(file.readline())
                    yield row["session"] if session is None else session, row["seq"], datetime.datetime.fromtimestamp(row["us"] / 1e6, datetime.UTC), row["p"]

    def commit(self, end: dict) -> None:
        pass


def session_frames(spark: SparkSession, path: str, max_bytes: int = 8 << 20) -> DataFrame:
    """session, seq, ts, p of all lines (seq, us, p, and session outside of a session's folder), as they come."""
    spark.dataSource.register(SessionLogs)
    return spark.readStream.format("session_logs").option("path", path).option("max_bytes", str(max_bytes)).load()
