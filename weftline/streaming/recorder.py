"""A stream of recorder logs: files of JSON lines that grow, read by byte ranges, so much at a time.

An offset is how far each file was read, always behind a line. What a batch takes is limited by bytes; large ranges are split among tasks, which begin at the first
line of their range and finish the last one that begins in it. Spark keeps the offsets in its checkpoint; as a source isn't told them when it is asked how
far it may go, the source notes what it last gave beside that, in the folder of option progress.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.zip_files import opened as _open
from .assembly import EVENTS

_FIELDS = [f.name for f in EVENTS.fields]
_LINE = 1 << 16


class Range(InputPartition):
    """The lines of a file that begin in a range of its bytes."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Log(DataSourceStreamReader):
    def __init__(self, path: str, progress: str, batch_bytes: int, split: int):
        self.path, self.progress, self.batch_bytes, self.split = path, progress, batch_bytes, split

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _noted(self) -> dict:
        store, place = _open(f"{self.progress}/offset.json")
        from pyarrow import fs

        if store.get_file_info(place).type != fs.FileType.File:
            return {}
        with store.open_input_stream(place) as f:
            return json.loads(f.read() or b"{}")

    def latestOffset(self) -> dict:  # noqa: N802
        """Behind what was given last, as many whole lines as the limit lets in; files in the order of their names, at least one line."""
        from pyarrow import fs

        store, top = _open(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        at, left = self._noted(), self.batch_bytes
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".jsonl")), key=lambda f: f.path):
            name = f.path.removeprefix(f"{top.rstrip('/')}/")
            start = at.get(name, 0)
            if left > 0 and f.size > start:
                end = self._behind_a_line(store, f.path, start, min(f.size, start + left), f.size)
                left -= end - start
                if end > start:
                    at[name] = end
        store, place = _open(self.progress)
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/offset.json") as out:
            out.write(json.dumps(at).encode())
        return at

    @staticmethod
    def _behind_a_line(store, path: str, start: int, end: int, size: int) -> int:  # noqa: ANN001
        """The last place behind a line up to end; if no line ends there, behind the first that ends after it; start if none does."""
        with store.open_input_file(path) as f:
            at = end
            while at > start:
                low = max(start, at - _LINE)
                if (place := f.read_at(at - low, low).rfind(b"\n")) >= 0:
                    return low + place + 1
                at = low
            while end < size:
                part = f.read_at(min(_LINE, size - end), end)
                if (place := part.find(b"\n")) >= 0:
                    return end + place + 1
                end += len(part)
        return start

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = ((name, start.get(name, 0), high) for name, high in sorted(end.items()))
        return [Range(f"{self.path.rstrip('/')}/{name}", low, min(low + self.split, high)) for name, first, high in ranges for low in range(first, high, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """Events of whole lines; lines that aren't events are left out."""
        store, path = _open(partition.path)
        with io.BufferedReader(store.open_input_file(path), 1 << 20) as f:
            at = partition.low
            if at:  # the line that begins before the range belongs to the one before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.high and (line := f.readline()):
                at += len(line)
                if (event := _event(line)) is not None:
                    yield event


def _event(line: bytes) -> tuple | None:
    try:
        row = json.loads(line)
        row["ts"] = datetime.fromisoformat(row["ts"])
        if not row.get("session") or not row.get("request_id"):
            return None
        return tuple(row.get(f) for f in _FIELDS)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class RecorderLog(DataSource):
    """format("recorder_log"): EVENTS from the .jsonl files below a path. Options: progress (a shared folder for the source's notes), batch_bytes, split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "recorder_log"

    def schema(self):  # noqa: ANN201
        return EVENTS

    def streamReader(self, schema) -> _Log:  # noqa: ANN001, ARG002, N802
        o = self.options
        return _Log(o["path"], o["progress"], int(o.get("batch_bytes", 256 << 20)), int(o.get("split", 64 << 20)))


def recorder_log(spark: SparkSession, path: str, progress: str, *, batch_bytes: int = 256 << 20, split: int = 64 << 20) -> DataFrame:
    """A stream of the events of recorder logs below path; progress is a folder of its own for each stream, as its checkpoint is."""
    spark.dataSource.register(RecorderLog)
    return spark.readStream.format("recorder_log").option("progress", progress).option("batch_bytes", str(batch_bytes)).option("split", str(split)).load(path)
