"""Named streams of a session: start once, stop, status, gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATUS_SCHEMA = "name string, active boolean, batch bigint, input_rows bigint, error string"


class StreamStopped(RuntimeError):
    """A stream which should run does not."""


class StreamRegistry:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._queries: dict[str, StreamingQuery] = {}

    def _find(self, name: str) -> StreamingQuery | None:
        running = (query for query in self.spark.streams.active if query.name == name)
        return next(running, self._queries.get(name))

    def start(self, name: str, build: Callable[[str], StreamingQuery]) -> bool:
        """Start the stream which ``build(name)`` makes, unless it runs. True if it was started."""
        if not name:
            raise ValueError("a stream needs a name")
        query = self._find(name)
        if query is not None and query.isActive:
            return False
        self._queries[name] = build(name)
        return True

    def stop(self, name: str, timeout: int = 5) -> bool:
        """Stop a stream and wait for its end. An unknown name is no error. True if one was stopped."""
        query = self._find(name)
        self._queries.pop(name, None)
        if query is None:
            return False
        query.stop()
        query.awaitTermination(timeout)
        return True

    def status(self) -> DataFrame:
        """One row per stream, running or ended."""
        names = {query.name for query in self.spark.streams.active if query.name} | set(self._queries)
        rows = []
        for name in sorted(names):
            query = self._find(name)
            last, error = query.lastProgress, query.exception()
            rows.append(
                (
                    name,
                    query.isActive,
                    last["batchId"] if last else None,
                    last["numInputRows"] if last else None,
                    str(error) if error else None,
                )
            )
        return self.spark.createDataFrame(rows, STATUS_SCHEMA)

    def require(self, name: str) -> None:
        """Raise unless the stream runs."""
        query = self._find(name)
        if query is None or not query.isActive:
            raise StreamStopped(f"stream for {name} is stopped")

    def wait(self, name: str) -> None:
        """Block until the stream ends; its failure is raised, not just logged."""
        query = self._find(name)
        if query is not None:
            query.awaitTermination()
