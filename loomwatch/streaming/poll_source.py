"""Polled feeds as a streaming source.

Each trigger asks every source for what is new since its last success. The windows of a batch are its offset: a window ends at
the time that was read before anything is fetched, and begins where the source's last successful one ended (at first so many hours
earlier), so a batch that is tried again asks for the same. A source is one partition, with a time limit of its own. If its fetch
fails, the batch has a row that says so and the source's next window begins where this one did; others aren't held up.

Which windows succeeded is kept as one small file a source and window under ``path``, which driver and tasks share.
"""

from __future__ import annotations

import concurrent.futures
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomwatch.settings import Settings

SCHEMA = "source_id string, window_start long, window_end long, ok boolean, seq int, payload string, error string"
#: (source, window start, window end, in microseconds) -> payloads.
Fetch = Callable[[str, int, int], Iterable[str]]


@dataclass(frozen=True)
class Source:
    """A feed: how it is asked, and how long that may take in seconds."""

    source_id: str
    fetch: Fetch
    timeout: float = 30.0


@dataclass
class Window(InputPartition):
    """What a task asks a source for."""

    source_id: str
    start: int
    end: int


class Marks:
    """The ends of successful windows, by source."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return fs, system, root.rstrip("/")

    @staticmethod
    def _name(source_id: str) -> str:
        return source_id.encode().hex() or "-"

    def ends(self, source_id: str) -> list[int]:
        fs, system, root = self._open()
        found = system.get_file_info(fs.FileSelector(f"{root}/{self._name(source_id)}", allow_not_found=True))
        return sorted(int(x.base_name) for x in found if x.base_name.isdigit())

    def put(self, source_id: str, end: int) -> None:
        _, system, root = self._open()
        system.create_dir(f"{root}/{self._name(source_id)}", recursive=True)
        with system.open_output_stream(f"{root}/{self._name(source_id)}/{end}"):
            pass

    def remove(self, source_id: str, ends: Iterable[int]) -> None:
        _, system, root = self._open()
        for end in ends:
            if system.get_file_info(f"{root}/{self._name(source_id)}/{end}").is_file:
                system.delete_file(f"{root}/{self._name(source_id)}/{end}")


class PollReader(DataSourceStreamReader):
    """Offsets are {"n": polls so far, "windows": {source: [start, end]}}."""

    def __init__(self, sources: list[Source], path: str, lookback_hours: float, clock: Callable[[], int]):
        self.sources, self.marks, self.lookback, self.clock = {s.source_id: s for s in sources}, Marks(path), int(lookback_hours * 3_600_000_000), clock
        self.n = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0, "windows": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        now, windows = self.clock(), {}
        for name in sorted(self.sources):
            done = [e for e in self.marks.ends(name) if e < now]
            windows[name] = [done[-1] if done else now - self.lookback, now]
        self.n = max(self.n + 1, now)
        return {"n": self.n, "windows": json.dumps(windows)}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return [Window(name, *w) for name, w in sorted(json.loads(end["windows"]).items()) if name in self.sources]

    def read(self, partition: Window) -> Iterator[tuple]:
        source, key = self.sources[partition.source_id], (partition.source_id, partition.start, partition.end)
        pool = concurrent.futures.ThreadPoolExecutor(1)
        try:
            found = pool.submit(lambda: list(source.fetch(*key))).result(source.timeout)
        except Exception as e:  # whatever a fetch raises, or that it takes too long
            self.marks.remove(partition.source_id, [partition.end])  # of an attempt before this one
            yield (*key, False, 0, None, f"{type(e).__name__}: {e}"[:200])
            return
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        for seq, payload in enumerate(found or [None]):
            yield (*key, True, seq, payload, None)
        self.marks.put(partition.source_id, partition.end)

    def commit(self, end: dict) -> None:
        """Of each source's marks only the last one is needed."""
        for name in self.sources:
            self.marks.remove(name, self.marks.ends(name)[:-1])


def register(spark: SparkSession, sources: list[Source], path: str, lookback_hours: float = Settings.first_run_lookback_hours, clock: Callable[[], int] | None = None, name: str = "polls") -> None:
    """Makes ``readStream.format(name)`` known to a session: rows of SCHEMA, at least one for each source and trigger. clock: microseconds."""
    read_clock = clock or (lambda: time.time_ns() // 1000)

    class PollSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> PollReader:  # noqa: N802
            return PollReader(sources, path, lookback_hours, read_clock)

    spark.dataSource.register(PollSource)
