"""What has been read, handed to those who asked for its type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Handler = Callable[[DataFrame], None]


class Bus:
    """Handlers by type of record. Handlers of one type are called in the order in which they were added."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Handler]] = {}
        self.failed: list[tuple[str, Exception]] = []

    def on(self, schema_type: str, handler: Handler) -> None:
        """'*' stands for all types."""
        self.handlers.setdefault(schema_type, []).append(handler)

    def emit(self, records: DataFrame) -> None:
        """Call every handler with the records of its type. One that fails doesn't keep the others from theirs; it is noted in failed."""
        records = records.persist()
        try:
            for kind, handlers in self.handlers.items():
                mine = records if kind == "*" else records.where(F.col("schema_type") == kind)
                for handler in handlers:
                    try:
                        handler(mine)
                    except Exception as e:  # noqa: BLE001 - whatever a handler raises is its own failure
                        self.failed.append((kind, e))
        finally:
            records.unpersist()

    def attach(self, stream: DataFrame, checkpoint: str):
        """The writer of a stream whose batches go through emit()."""
        return stream.writeStream.foreachBatch(lambda rows, _: self.emit(rows)).option("checkpointLocation", checkpoint)
