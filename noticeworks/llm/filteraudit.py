"""Filter interaction audit: what each filter removes in every order in which filters can be applied.

Orders are numbered by their Lehmer rank (their place among all permutations, sorted). Orders that begin alike have
adjacent ranks, so the orders in which a row that fails a given set of filters (its mask) leaves at a given step form
intervals of ranks. Counts of masks are added at the intervals' ends; sums over the ranks give the totals of all orders.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_chunks, pieces, store

#: With more filters the table of orders (k! of them, k steps each) would no longer be small enough to broadcast.
MOST_FILTERS = 7


def lehmer_rank(prefix: tuple[int, ...], k: int) -> int:
    """The least rank of the permutations of 0 .. k - 1 that begin with ``prefix``."""
    return sum(sum(g < f for g in range(k) if g not in prefix[:i]) * factorial(k - 1 - i) for i, f in enumerate(prefix))


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, low, high): in the orders ranked low .. high - 1 a row that fails the filters of ``mask`` leaves at
    ``step`` (from 1)."""
    found = defaultdict(list)
    for step in range(1, k + 1):
        for prefix in permutations(range(k), step):
            low = lehmer_rank(prefix, k)
            free = [f for f in range(k) if f not in prefix]  # those that come later may fail or not
            for chosen in range(1 << len(free)):
                mask = 1 << prefix[-1] | sum(1 << f for i, f in enumerate(free) if chosen >> i & 1)
                found[mask, step].append((low, low + factorial(k - step)))
    out = []
    for (mask, step), spans in sorted(found.items()):
        low, high = spans[0]  # prefixes come in the order of their ranks
        for a, b in spans[1:]:
            if a != high:
                out.append((mask, step, low, high))
                low = a
            high = b
        out.append((mask, step, low, high))
    return out


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of a bounded number of rows, for a broadcast."""
    columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int32()) for c in zip(*rows, strict=True)]
    return F.broadcast(spark.createDataFrame(pa.table(columns, names)))


def _orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """rank, step, filter_order and the place in ``names`` of the filter that comes at this step."""
    rows = [(rank, step, "".join(names[f] for f in order), order[step - 1]) for rank, order in enumerate(permutations(range(len(names)))) for step in range(1, len(names) + 1)]
    return _small(spark, rows, ["rank", "step", "filter_order", "filter"])


def audit_orders(rows: DataFrame, filters: dict[str, Column], *, part: Column, measures: dict[str, Column]) -> DataFrame:
    """Apply ``filters`` (name: whether a row fails it) to the rows of each part in every order.

    Returns a row for each part, filter_order (names joined) and step (from 1): the rows kept after the step, removed by
    it, redundant (they fail its filter but were removed earlier), unique_fails (they fail its filter only), a column
    for each of ``measures`` (how many of the removed rows have it) and shapley (rows that its filter removes, summed
    over all orders). A null condition does not fail; a null part is the empty string. Every row counts, repeated ones
    too; an empty table has no part. Names may be anything: columns are taken from ``rows`` as they are given.
    """
    k, spark = len(filters), rows.sparkSession
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    orders, sums = factorial(k), ["n", *(f"m{i}" for i in range(len(measures)))]
    true = lambda c: F.coalesce(c.cast("boolean"), F.lit(False)).cast("long")
    mask = sum((true(c) * (1 << i) for i, c in enumerate(filters.values())), F.lit(0).cast("long")).cast("int")
    counts = store(
        rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *(true(c).alias(f"m{i}") for i, c in enumerate(measures.values())))
        .groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in sums[1:])),
        "filter-masks",
    ).df
    intervals = _small(spark, removal_intervals(k), ["mask", "step", "low", "high"])
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign"))))
    deltas = counts.join(intervals, "mask").select("part", "step", ends.alias("end"), *sums).select("part", "step", "end.rank", *((F.col(s) * F.col("end.sign")).alias(s) for s in sums)).filter(F.col("rank") < orders)
    has = lambda f: F.col("mask").bitwiseAND(F.lit(1 << f)) > 0
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*(F.sum(F.when(has(f), F.col("n")).otherwise(0)) for f in range(k))).alias("fails"),
        F.array(*(F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(k))).alias("unique"),
    )
    grid = totals.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    cells = (
        grid.unionByName(deltas, allowMissingColumns=True).repartition("part")  # a part has at most so many cells, and all that follows needs them together
        .groupBy("part", "step", "rank").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums), *(F.first(c, ignorenulls=True).alias(c) for c in ("total", "fails", "unique")))
    )
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = cells.withColumns({s: F.sum(s).over(along) for s in sums}).join(_orders(spark, list(filters)), ["rank", "step"])
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.element_at(c, F.col("filter") + 1)
    return removed.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(steps)).alias("kept"), F.col("n").alias("removed"), (at("fails") - F.col("n")).alias("redundant"), at("unique").alias("unique_fails"),
        *(F.col(s).alias(name) for s, name in zip(sums[1:], measures, strict=True)),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


#: A word, in UTF-8: a run of anything but the six ASCII white spaces.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CAPITALS, CONTINUED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class TextFilters:
    """Whether a text fails: A, fewer words than ``least_words``; B, fewer distinct words than ``least_distinct`` per
    cent; C, more than ``most_capitals`` per cent of its code points in A-Z; D, one of ``symbols`` (ASCII)."""

    least_words: int = 200
    least_distinct: int = 50
    most_capitals: int = 2
    symbols: bytes = b"#$%&*|"

    def fails(self, text: bytes) -> tuple[bool, bool, bool, bool]:
        n, distinct = 0, set()
        for piece in pieces(text, WORD):
            words = piece.split()  # of bytes: at the ASCII white spaces
            n += len(words)
            distinct.update(words)
        without = lambda these: len(text) - len(text.translate(None, these))
        points = len(text) - without(CONTINUED)
        return n < self.least_words, 100 * len(distinct) < self.least_distinct * n, 100 * without(CAPITALS) > self.most_capitals * points, without(self.symbols) > 0

    def flags(self, docs: DataFrame) -> DataFrame:
        """Of columns doc_id, part and text (null: empty): doc_id, part, the text's SHA-256 and A to D."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in byte_chunks(batches):
                columns = [batch.column("doc_id"), batch.column("part"), pa.array([sha256(t).digest() for t in texts], pa.binary())]
                columns += [pa.array(c, pa.bool_()) for c in zip(*map(self.fails, texts), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", *"ABCD"])

        kinds = dict(docs.dtypes)
        return docs.select("doc_id", "part", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, part string, digest binary, A boolean, B boolean, C boolean, D boolean")


def audit_documents(docs: DataFrame, labels: DataFrame, filters: TextFilters | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of ``filters`` and of E: the text is that of a row with a smaller id.

    ``labels`` has doc_id, quality and toxic; an id counts as good or toxic if any of its rows says so. Null texts are
    empty texts. A row without an id copies no other and is copied by none; rows that share id and text are no copies
    of each other. Texts are the same if their SHA-256 is. Only flags, ids and these digests move between tasks.
    """
    named = docs.select(docs[id_col].alias("doc_id"), docs[part_col].cast("string").alias("part"), docs[text_col].cast("string").alias("text"))
    flags = store((filters or TextFilters()).flags(named), "filter-flags")
    # Written, so that the join deals both sides itself and can split a text of very many copies.
    first = store(flags.df.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "first-copies")
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = flags.df.join(first.df, "digest").join(said, "doc_id", "left")
    conditions = {f: F.col(f) for f in "ABCD"} | {"E": F.col("first_id") < F.col("doc_id")}
    out = audit_orders(rows, conditions, part=F.col("part"), measures={"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
    flags.drop()
    first.drop()
    return out
