"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Native: DataFrame functions only. A row's number is its place in the order of ids. The permutation sends it to a place
in the shuffled order; shard and slot are that place modulo and divided by the number of shards. So a row's shard and
slot can be computed from its number, and the number from them, without a table; counts of shards differ by one at
most, and a shuffle depends on the rows and the seed alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeworks.tables import store

#: Round functions work modulo this prime (2**31 - 1), so that products of two values fit in a long.
PRIME = 2_147_483_647
ROUNDS = 8
#: Steps of cycle walking that are tried first.
WALK = 2


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. n - 1 as column expressions.

    A number x below a * b (a = ceil(sqrt(n)), b the least that holds n) is split into x div b and x mod b. Rounds add
    a keyed hash of one half to the other, modulo the other's size, in turn; so one pass permutes a * b numbers, of
    which fewer than a are n or more. A result of n or more goes through again until it is below n (cycle walking).
    That ends, as a cycle that starts below n comes back there.
    """

    n: int
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.n < 1 << 61:
            raise ValueError("the number of rows must lie in 0 .. 2**61 - 1")

    @property
    def sizes(self) -> tuple[int, int]:
        a = math.isqrt(max(0, self.n - 1)) + 1
        return a, max(1, -(-self.n // a))

    @property
    def keys(self) -> list[tuple[int, int]]:
        """(multiplier, summand) of each round, from a multiplicative generator that the seed starts."""
        x, out = self.seed % (PRIME - 1) + 1, []
        for _ in range(2 * ROUNDS + 16):
            x = x * 48_271 % PRIME
            out.append(x)
        return list(zip(out[16::2], out[17::2], strict=True))

    def _keys(self, keys: list[tuple[int, int]]) -> Column:
        return F.array(*(F.struct(F.lit(m).cast("long").alias("multiplier"), F.lit(s).cast("long").alias("summand")) for m, s in keys))

    @staticmethod
    def _hash(half: Column, key: Column) -> Column:
        t = (half % PRIME * key["multiplier"] + key["summand"]) % PRIME
        return t * t % PRIME

    @staticmethod
    def _halves(fixed: Column, moved: Column, fixed_size: Column, moved_size: Column) -> Column:
        """The half that is hashed, the one that it is added to, and their sizes."""
        return F.struct(fixed.alias("fixed"), moved.alias("moved"), fixed_size.alias("fixed_size"), moved_size.alias("moved_size"))

    def step(self, x: Column) -> Column:
        """One pass through all rounds, without walking."""
        a, b = (F.lit(v).cast("long") for v in self.sizes)

        def one(h: Column, key: Column) -> Column:
            return self._halves((h["moved"] + self._hash(h["fixed"], key)) % h["moved_size"], h["fixed"], h["moved_size"], h["fixed_size"])

        return F.aggregate(self._keys(self.keys), self._halves(x % b, _div(x, b), b, a), one, lambda h: h["moved"] * b + h["fixed"])

    def back(self, y: Column) -> Column:
        """The inverse of ``step``."""
        a, b = (F.lit(v).cast("long") for v in self.sizes)

        def one(h: Column, key: Column) -> Column:
            return self._halves(h["moved"], F.pmod(h["fixed"] - self._hash(h["moved"], key), h["fixed_size"]), h["moved_size"], h["fixed_size"])

        return F.aggregate(self._keys(self.keys[::-1]), self._halves(y % b, _div(y, b), b, a), one, lambda h: h["moved"] * b + h["fixed"])

    def _walked(self, step, x: Column, walk: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), step(x), lambda y, _: F.when(y < self.n, y).otherwise(step(y))) if walk else step(x)

    def place(self, number: Column, walk: int) -> Column:
        """The place in the shuffled order; ``walk`` comes from ``walk_length``."""
        return self._walked(self.step, number, walk)

    def number(self, place: Column, walk: int) -> Column:
        """The row number at a place: the inverse of ``place``."""
        return self._walked(self.back, place, walk)

    def walk_length(self, spark: SparkSession) -> int:
        """So many more passes bring every number below n. Walks begin at those numbers of n or more (fewer than
        sqrt(n) + 1) that a number below n is sent to; Spark tries them all."""
        a, b = self.sizes
        beyond = a * b - self.n
        walk = min(WALK, beyond)
        begins = self.back(F.col("id")) < self.n
        while walk < beyond and spark.range(self.n, a * b).filter(begins & (self.place(F.col("id"), walk - 1) >= self.n)).limit(1).count():
            walk = min(2 * walk, beyond)
        return walk


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with its rows numbered from 0 without a gap, in the order of columns ``order`` (nulls first).

    Rows are dealt out by ranges and sorted there; a range's first number is the count of the rows before it. Rows equal
    in ``order`` are split among ranges however many there are; give all columns that tell rows apart, so that numbers
    do not depend on the partitioning. Two columns more, ``_range`` and ``_at``, are used inside.
    """
    salted = df.withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at")
    kept = store(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered").df
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = kept.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row for each range
    return kept.join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")


def shard_rows(docs: DataFrame, shards: int, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards, in an order shuffled by ``seed``.

    Returns a row for each row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned),
    row_number (its place by id; nulls first, then by size and text), shard and slot (from 0 without a gap in each
    shard; counts of shards differ by one at most). A null text counts as empty. Rows that share id and text get
    numbers of their own, in any order, which does not show in the result. Only ids, sizes and hashes of texts move.
    An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    narrow = store(docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_text")), "shard-rows")
    numbered = number_rows(narrow.df, ["doc_id", "size", "text_crc32", "_text"])
    narrow.drop()
    permutation = Feistel(numbered.count(), seed)
    place = permutation.place(F.col("row_number"), permutation.walk_length(docs.sparkSession))
    placed = numbered.withColumn("place", place)
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), _div(F.col("place"), F.lit(shards)).alias("slot"))
