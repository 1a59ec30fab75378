"""Rows that wait for their delivery, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeworks.tables import drop_path, exists, names_in, touch

#: Batches whose marks stay after their delivery. Spark repeats the last batch of a query at most.
KEPT = 100


class Outbox:
    """A folder for each batch of rows, and a mark for each batch that was delivered.

    A batch waits from ``put`` until ``mark``, over restarts; a batch put again before its delivery replaces itself, and
    one put again after it is left alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, number: int) -> str:
        return f"{self.path}/rows-{number:010d}"

    def _sent(self, number: int) -> str:
        return f"{self.path}/sent-{number:010d}"

    def _numbers(self, kind: str) -> list[int]:
        return [int(n.rsplit("-", 1)[1]) for n in names_in(self.spark, self.path) if n.startswith(f"{kind}-")]

    def is_sent(self, number: int) -> bool:
        return exists(self.spark, self._sent(number))

    def put(self, rows: DataFrame, number: int) -> bool:
        """Whether the batch waits now."""
        if self.is_sent(number):
            return False
        rows.write.mode("overwrite").parquet(self._folder(number))
        return True

    def waiting(self) -> list[int]:
        sent = set(self._numbers("sent"))
        return [n for n in self._numbers("rows") if n not in sent and exists(self.spark, f"{self._folder(n)}/_SUCCESS")]

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self._folder(number))

    def mark(self, number: int) -> None:
        touch(self.spark, self._sent(number))
        drop_path(self.spark, self._folder(number))
        for old in self._numbers("sent"):
            if old < number - KEPT:
                drop_path(self.spark, self._sent(old))
