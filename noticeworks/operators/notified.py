"""The notified state as keyed tables: what a batch reads and writes follows the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.keyed import KeyedTable
from noticeworks.tables import store

from .state import STATE_SCHEMA, changed_entries, drop_notified, prune_state


def _names(entries: DataFrame) -> DataFrame:
    """(key, entry): the names of each entry."""
    names = F.array_union(F.array("primary_key"), F.coalesce("alias_keys", F.array().cast("array<string>")))
    return entries.select(F.explode(names).alias("key"), F.col("primary_key").alias("entry"))


class NotifiedState:
    """Entries by primary key, and an index of their names.

    A name finds its entries in the index's buckets, and they are read from theirs; both tables are changed by deltas.
    The index may name entries that are gone or that have lost a name: entries are read before they count.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64):
        self.entries = KeyedTable(spark, f"{path}/entries", STATE_SCHEMA, ["primary_key"], buckets=buckets)
        self.names = KeyedTable(spark, f"{path}/names", "key string, entry string", ["key", "entry"], buckets=buckets)

    def read(self, *, before: int | None = None) -> DataFrame:
        return self.entries.read(before=before)

    def lookup(self, rows: DataFrame, *, before: int | None = None) -> DataFrame:
        """The entries that any of the rows' ``keys`` or its ``primary_key`` names."""
        asked = rows.select(F.explode(F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.array("primary_key"))).alias("key"))
        found = self.names.lookup(asked, before=before).select("entry")
        return self.entries.lookup(found, before=before)

    def known(self, rows: DataFrame, now: Column, *, before: int | None = None, retention_days: int = 90) -> DataFrame:
        """The entries of ``lookup`` but those past retention."""
        return prune_state(self.lookup(rows, before=before), now, retention_days)

    def put(self, changed: DataFrame, *, turn: int | None = None) -> int:
        """Entries that are new or changed. Names come first: a name without its entry means nothing."""
        turn = self.entries.turn() + 1 if turn is None else turn
        kept = store(changed, "changed-entries")
        self.names.write(_names(kept.df), turn=turn)
        self.entries.write(kept.df, turn=turn)
        kept.drop()
        return turn

    def mark(self, rows: DataFrame, now: Column, *, retention_days: int = 90) -> int:
        """The state after rows were notified."""
        return self.put(changed_entries(self.known(rows, now, retention_days=retention_days), rows, now))

    def take(self, rows: DataFrame, now: Column, *, turn: int, retention_days: int = 90) -> int:
        """The rows that were not notified before ``turn`` are now."""
        held = store(self.known(rows, now, before=turn, retention_days=retention_days), "known-entries")
        self.put(changed_entries(held.df, drop_notified(rows, held.df), now), turn=turn)
        held.drop()
        return turn

    def compact(self, now: Column, retention_days: int = 90) -> int:
        """Merge the deltas; entries past retention go for good, and so do names that lead nowhere."""
        turn = self.entries.compact(lambda rows: prune_state(rows, now, retention_days))
        self.names.rebase(_names(self.entries.read()))
        return turn
