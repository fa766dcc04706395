"""Progress of a job while it runs: files that tasks have done with are counted, and a caller's function is told.

Counts come with the ends of tasks. A task that is tried again counts its files again, so that what is told never exceeds the number of files.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Progress:
    """A context in which `told(done, total)` is called as files are done, and once more at its end. What it raises reaches nobody."""

    def __init__(self, total: int, told: Callable[[int, int], None] | None, every: float = 0.5):
        self.total, self.told, self.every = total, told, every
        self._done, self._last = None, None
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def counted(self, files: DataFrame) -> DataFrame:
        """files, counted as a task takes them; as they are if nobody is told. Rows go through a Python worker and are not changed."""
        if self.told is None:
            return files
        self._done = done = files.sparkSession.sparkContext.accumulator(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done.add(batch.num_rows)
                yield batch

        return files.mapInArrow(run, files.schema)

    def _tell(self) -> None:
        now = min(self._done.value, self.total) if self._done is not None else 0
        if self.told is None or now == self._last:
            return
        self._last = now
        try:
            self.told(now, self.total)
        except Exception:  # noqa: BLE001
            return

    def _watch(self) -> None:
        while not self._end.wait(self.every):
            self._tell()

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._end.set()
        self._thread.join()
        self._tell()
