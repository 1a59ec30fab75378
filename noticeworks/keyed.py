"""Tables of one row for each key that are changed without being rewritten (K3): a base in hash buckets, and deltas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.tables import drop_path, exists, names_in, touch


class KeyedTable:
    """Rows of ``schema``, one for each ``key``, under one folder.

    A change is a delta: the rows that are new or changed, and the keys that are gone. Each delta has a turn, and for a
    key the row of the latest turn counts, so what a change writes follows the change, however large the table is.
    ``compact`` merges base and deltas into a new base, apart from the changes. The base lies in hash buckets of ``place``
    (a column of the key), of which ``lookup`` reads those alone that its keys fall into; deltas are sorted by bucket.

    A folder counts once Spark's commit marker is in it: a write that fails leaves the table as it was, and a turn that is
    written again replaces itself. One writer at a time; readers need none to wait, as what a compaction replaces stays
    until the next one. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], *, place: str | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.place = spark, path.rstrip("/"), key, place or key[0]
        self.schema = spark.createDataFrame([], schema).schema
        begun = [int(n.rsplit("-", 1)[1]) for n in names_in(spark, self.path) if n.startswith("buckets-")]
        self.buckets = min(begun, default=buckets)  # those that the table was begun with
        if not begun:
            touch(spark, f"{self.path}/buckets-{buckets}")

    def _folders(self) -> list[tuple[int, str]]:
        """(turn, kind) of the whole ones."""
        found = [(int(n.split("=")[1]), kind) for kind in ("base", "delta") for n in names_in(self.spark, f"{self.path}/{kind}")]
        return sorted(x for x in found if exists(self.spark, f"{self._folder(x[1], x[0])}/_SUCCESS"))

    def _folder(self, kind: str, turn: int) -> str:
        return f"{self.path}/{kind}/_turn={turn}"

    def _parts(self, before: int | None) -> tuple[list[int], list[int]]:
        """Turns of the base in force (none or one) and of the deltas after it."""
        turns = [(t, kind) for t, kind in self._folders() if before is None or t < before]
        base = [t for t, kind in turns if kind == "base"][-1:]
        return base, [t for t, kind in turns if kind == "delta" and t > (base[0] if base else -1)]

    def turn(self) -> int:
        """The latest turn; 0 if there is none."""
        return max((t for t, _ in self._folders()), default=0)

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _load(self, kind: str, turns: list[int], hit: list[int] | None) -> DataFrame:
        stored = self.spark.createDataFrame([], self.schema).withColumns({"_gone": F.lit(False), "_turn": F.lit(0).cast("long"), "_bucket": F.lit(0)})
        if not turns:
            return stored
        # One scan of all folders; turns, and a base's buckets, are read from the paths.
        rows = self.spark.read.schema(stored.schema).option("basePath", f"{self.path}/{kind}").parquet(*(self._folder(kind, t) for t in turns))
        return rows if hit is None else rows.filter(F.col("_bucket").isin(hit))

    def _merged(self, before: int | None, hit: list[int] | None) -> DataFrame:
        base, deltas = self._parts(before)
        held = self._load("base", base, hit)
        columns = self.schema.names
        if deltas:
            last = self._load("delta", deltas, hit).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key))).agg(F.max_by(F.struct(*columns, "_gone"), "_turn").alias("_row"))
            same = [held[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
            changed = last.filter("not _row._gone").select("_row.*").select(*columns)
            return held.join(last, same, "left_anti").select(*columns).unionByName(changed)
        return held.select(*columns)

    def read(self, *, before: int | None = None) -> DataFrame:
        """The table, as it was before a turn."""
        return self._merged(before, None)

    def lookup(self, places: DataFrame, *, before: int | None = None) -> DataFrame:
        """The rows whose ``place`` is in the one column of ``places``. Only the numbers of the buckets (at most
        ``buckets``) pass through the driver."""
        if not self.turn():
            return self.spark.createDataFrame([], self.schema)
        asked = places.toDF("_asked").distinct()
        hit = [r[0] for r in asked.select(self._bucket(F.col("_asked"))).distinct().collect()]
        held = self._merged(before, hit if len(hit) < self.buckets else None)
        return held.join(asked, held[self.place].eqNullSafe(asked["_asked"]), "left_semi")

    def _write(self, rows: DataFrame, kind: str, turn: int) -> None:
        out = rows.withColumn("_bucket", self._bucket(F.col(self.place))).hint("rebalance", "_bucket")  # few files; large ones are split
        if kind == "base":
            out.write.mode("overwrite").partitionBy("_bucket").parquet(self._folder(kind, turn))
        else:
            out.sortWithinPartitions("_bucket").write.mode("overwrite").parquet(self._folder(kind, turn))

    def write(self, rows: DataFrame, *, gone: DataFrame | None = None, turn: int | None = None) -> int:
        """Add or replace ``rows`` (one for each key), and take out the keys in ``gone`` (the columns of the key).
        Returns the turn; by default it is the next one."""
        turn = self.turn() + 1 if turn is None else turn
        delta = rows.select(*self.schema.names).withColumn("_gone", F.lit(False))
        if gone is not None:
            delta = delta.unionByName(gone.select(*self.key).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        self._write(delta, "delta", turn)
        return turn

    def compact(self, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Merge base and deltas into a base of the rows that ``keep`` returns. What the compaction before this one
        replaced goes."""
        return self.rebase(keep(self.read()))

    def rebase(self, rows: DataFrame) -> int:
        """Make ``rows`` the base of the latest turn."""
        held, turn = self._folders(), self.turn()
        old = [t for t, kind in held if kind == "base"][-1:]
        if turn and (turn, "base") not in held:
            self._write(rows.select(*self.schema.names).withColumn("_gone", F.lit(False)), "base", turn)
            for t, kind in held:
                if old and (t < old[0] or t == old[0] and kind == "delta"):
                    drop_path(self.spark, self._folder(kind, t))
        return turn
