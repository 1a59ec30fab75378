"""SimHash near-duplicates, with pivot distance tables.

Fingerprints that differ in at most 4 of 64 bits agree in at least 3 of 7 bit blocks, so every link lies in one of
35 tables keyed by three blocks. Candidate pairs of a bucket, in both passes below, are held against the table of their
distances to fixed pivots: if a coordinate differs by more than the allowed distance, so do the fingerprints. Survivors
are verified.

Only links between different components are of interest, so a first pass links neighbours in sorted buckets, and the
second pass looks only into buckets that still hold several components. No bucket's pairs are all written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.components import components

from .common import byte_chunks, store
from .nearcopies import one_of_each  # the operator's entrance for word shingles at a similarity of 0.8
from .pivots import near, near_pairs, pivot_distances, pivot_table

__all__ = ["fingerprint", "fingerprints", "near_duplicates", "near_pairs", "one_of_each"]

SEED, SHINGLE, DISTANCE = 42, 4, 4
BLOCKS = [(0, 10), *((10 + 9 * i, 9) for i in range(6))]
TABLES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
NEIGHBOURS = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned; 0 if it has no word."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    if len(start) > shingle:
        start, end = start[: 1 - shingle], end[shingle - 1 :]
    else:
        start, end = start[:1], end[-1:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(start), 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[i : i + (1 << 15)].tolist(), end[i : i + (1 << 15)].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long")


def table_keys(fp: Column) -> Column:
    """A key for each of the tables: the table's number above the bits of its blocks."""
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for at, n in BLOCKS]
    keys = []
    for k, table in enumerate(TABLES):
        key = F.lit(k).cast("long")
        for b in table:
            key = F.shiftleft(key, BLOCKS[b][1]).bitwiseOR(part[b])
        keys.append(key)
    return F.array(*keys)


def _neighbour_links(tables: DataFrame, distance: int) -> DataFrame:
    """Links between near neighbours in the order of (key, fp); which are found depends on the partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((2, 0), np.int64)
        for batch in batches:
            key, fp = np.concatenate([tail, [batch.column("key").to_numpy(), batch.column("fp").to_numpy()]], axis=1)
            table = pivot_table(fp.view(np.uint64))
            u, v = [], []
            for d in range(1, min(NEIGHBOURS, len(fp) - 1) + 1):
                same = np.flatnonzero(key[d:] == key[:-d])
                at = same[near_pairs(fp.view(np.uint64), same, same + d, distance, table)]
                u.append(np.maximum(fp[at + d], fp[at]))
                v.append(np.minimum(fp[at + d], fp[at]))
            if u:
                pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])
            tail = np.stack([key[-NEIGHBOURS:], fp[-NEIGHBOURS:]])

    n = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.repartitionByRange(n, "key", "fp").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long").distinct()


def fingerprint_components(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for distinct fingerprints ``fps``; fingerprints that nothing links have no row."""
    tables = fps.select("fp", F.explode(table_keys(F.col("fp"))).alias("key"))
    first = components(_neighbour_links(tables, distance))
    named = fps.join(first.df.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"))
    keyed = named.select("fp", "root", F.explode(table_keys(F.col("fp"))).alias("key"))
    # Only buckets that hold several components can add a link; of those, the largest component only answers.
    mixed = keyed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("key", F.col("top.root").alias("top"))
    rows = store(keyed.join(mixed, "key").select("key", "fp", "root", "top", *(p.alias(f"p{i}") for i, p in enumerate(pivot_distances(F.col("fp"))))), "simhash-mixed")
    a, b = rows.df.filter("root <> top").alias("a"), rows.df.alias("b")
    links = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & near("a", "b", distance)).select(F.greatest("a.root", "b.root").alias("u"), F.least("a.root", "b.root").alias("v")).distinct()
    second = components(links)
    rows.drop()
    up = second.df.select(F.col("u").alias("root"), F.col("v").alias("top"))
    below = first.df.select(F.col("u").alias("fp"), F.col("v").alias("root")).join(up, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))
    # A least node of the first pass that the second pass moved.
    return below.unionByName(up.select(F.col("root").alias("fp"), F.col("top").alias("root")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the least id reachable.

    Texts link if their fingerprints differ in at most ``distance`` (up to 4) bits. Null, empty and wordless texts
    have fingerprint zero and link like any other. Repeated rows stay; a null id never names a component unless all
    its ids are null. An empty table gives an empty result. Other columns are not read.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be 0 to {DISTANCE}")
    marked = store(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-fp").df
    fps = store(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct").df
    roots = store(fingerprint_components(fps.select("fp"), distance), "simhash-roots").df
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
