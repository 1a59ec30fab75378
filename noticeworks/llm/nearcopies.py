"""Near copies for the corpus pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash and pivot distance tables. At that similarity about 15 % of a fingerprint's bits differ, so a
fingerprint has BITS bits and each of many tables takes a key and REST further bits from them. A pair is looked at where
it shares a table's key; there the distances of its REST bits to the pivots discard it, or the bits themselves do, if
more than RADIUS differ. The longer the key, the more tables: as many as would leave a pair at 0.8 unseen with probability
MISS, were no bit in two tables. What is left is held against the whole fingerprints and then verified on the shingle sets, so no pair below SIMILAR links.

A row of a bucket meets its next WINDOW rows in order, and only what is near to one of them goes on, as one row with the text of
those that is near to most. Such pairs of texts, if their whole fingerprints are near, make near groups. What is near in a
bucket and lies in different groups joins them, also in buckets with more rows, which are joined with themselves for that.
Each group is then compared whole: its texts are dealt into chunks, and two chunks meet in a task, which compares the
fingerprints and verifies what its own links do not yet connect. So rows are written for texts, links and chunks met, and
for no pair inside a group. Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.components import components

from .common import Stored, bloom_filter, byte_chunks, may_hold, store
from .pivots import near, near_pairs, pivot_distances, pivot_table
from .wordhash import mix

SEED, SHINGLE, BITS = 42, 5, 1024
#: The least similarity of a link, as numerator and denominator.
SIMILAR = (4, 5)
#: Bits that a table compares beside its key, and how many of them may differ.
REST, RADIUS = 32, 6
#: A bucket has about FULL texts that are not near; its rows meet WINDOW others before it is joined with itself.
FULL, WINDOW = 64, 128
#: The share of bits that differ at SIMILAR; up to BRIEF shingles it is greater (4 of 5 shingles: 3/16), so those texts have more tables.
SHARE, BRIEF, BRIEF_SHARE = 0.1515, 5, 0.1875
#: The probability that a pair at SIMILAR shares no table, if all tables had bits of their own.
MISS, BRIEF_MISS = 1e-6, 1e-8
#: Bits of the whole fingerprint that a candidate may differ in: 5 standard deviations above the mean at SIMILAR.
APART, BRIEF_APART = 216, 256
#: Bits of a code: its table's number, its key, REST.
TABLE_BITS, KEY_BITS = 11, 21
#: Texts and shingles of a chunk of a near group.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Rows that get their codes at a time.
STEP = 1 << 8


def joined(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def shingle_set(words: bytes) -> np.ndarray:
    """The distinct hashes of the shingles of joined words; a text of fewer words is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    start, end = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(words)]
    start, end = (start[: 1 - SHINGLE], end[SHINGLE - 1 :]) if len(start) > SHINGLE else (start[:1], end[-1:])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(words[a:b], SEED) for a, b in zip(start, end, strict=True)), np.uint64, len(start)))


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    masks, factors = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BITS // 64), np.uint64)
    return masks, factors | np.uint64(1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, BITS bits in signed words: a bit is 1 if set in over half of the hashes."""
    masks, factors = _multipliers()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), 255):
        words = mix((shingles[i : i + 255, None] ^ masks) * factors)
        counts += np.unpackbits(words.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(shingles)).view(np.int64)


def key_bits(texts: int) -> int:
    """Bits of a key that leave about FULL of so many texts in a bucket."""
    return min(max(ceil(log(max(texts, 1) / FULL, 2)), 4), KEY_BITS - 1)


def table_count(key: int, *, brief: bool = False) -> int:
    """The number of tables for keys of so many bits."""
    share, miss = (BRIEF_SHARE, BRIEF_MISS) if brief else (SHARE, MISS)
    seen = (1 - share) ** key * sum(comb(REST, i) * share**i * (1 - share) ** (REST - i) for i in range(RADIUS + 1))
    return min(ceil(log(miss) / log(1 - seen)), 1 << TABLE_BITS)


@lru_cache(maxsize=1)
def _places(key: int) -> np.ndarray:
    """For each table the places that its codes' 64 bits take from a fingerprint to which a 0 and a 1 are added."""
    rng, order, out = np.random.default_rng(SEED), np.zeros(0, np.int64), []
    for t in range(table_count(key, brief=True)):
        if len(order) < key + REST:
            order = rng.permutation(BITS)
        number = [BITS + (t >> b & 1) for b in range(TABLE_BITS - 1, -1, -1)]
        out.append([*number, *[BITS] * (KEY_BITS - key), *order[: key + REST]])
        order = order[key + REST :]
    return np.array(out)


def codes(prints: np.ndarray, key: int, tables: int) -> np.ndarray:
    """The codes (signed) of fingerprints, a column for each table."""
    added = np.tile(np.array([0, 1], np.uint8), (len(prints), 1))
    bits = np.concatenate([np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1), added], axis=1)
    return np.packbits(np.take(bits, _places(key)[:tables].ravel(), axis=1), axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(len(prints), tables)


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets of shingles (sorted, none empty) reach SIMILAR with ``one``."""
    over, under = SIMILAR
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    both = np.add.reduceat(one[np.searchsorted(one, flat).clip(max=len(one) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    return (over + under) * both >= over * (len(one) + sizes)


def could_be_similar(a: Column, b: Column) -> Column:
    """By the sizes."""
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def _node(words: bytes) -> int:
    n = xxhash.xxh64_intdigest(words, SEED)
    return n - (1 << 64) if n >> 63 else n


def _marked(docs: DataFrame) -> DataFrame:
    """(id, tid, node, size, print): the hashes of the text and of its words, the number of distinct shingles, the
    fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches):
            words = [joined(t) for t in texts]
            sizes, prints = [], []
            for w in words:
                own = shingle_set(w)
                sizes.append(len(own))
                prints.append(fingerprint(own))
            columns = [batch.column("id"), batch.column("tid"), pa.array([_node(w) for w in words], pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tid", "node", "size", "print"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, tid long, node long, size long, print array<long>")


def _rows(nodes: DataFrame, key: int) -> DataFrame:
    """(code, node): a row for each text and table. Texts without words have none."""
    usual, brief = table_count(key), table_count(key, brief=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column("node").to_numpy(), batch.column("size").to_numpy()
            prints = batch.column("print").flatten().to_numpy().reshape(len(node), -1)
            for tables, which in ((usual, size > BRIEF), (brief, (size > 0) & (size <= BRIEF))):
                at = np.flatnonzero(which)
                for i in range(0, len(at), STEP):
                    part = at[i : i + STEP]
                    yield pa.RecordBatch.from_arrays([pa.array(codes(prints[part], key, tables).ravel()), pa.array(np.repeat(node[part], tables))], ["code", "node"])

    return nodes.select("node", "size", "print").mapInArrow(run, "code long, node long")


def _bucket(code: Column) -> Column:
    return F.shiftrightunsigned(code, REST)


def _dealt(rows: DataFrame, bucket: Column) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, bucket)


def _found(rows: DataFrame) -> DataFrame:
    """(bucket, fp, node, best): what is near to another row of its bucket, with that of those that is near to most; a row
    may come twice. Rows without a node name buckets of which not all rows have met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((2, 0), np.int64)
        for batch in batches:
            code, node = np.concatenate([tail, [batch.column("code").to_numpy(), batch.column("node").to_numpy()]], axis=1)
            bucket, fp = code.view(np.uint64) >> np.uint64(REST), code.view(np.uint64) & np.uint64((1 << REST) - 1)
            table = pivot_table(fp)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, min(WINDOW, len(code) - 1) + 1):
                same = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not len(same):
                    break
                at = same[near_pairs(fp, same, same + d, RADIUS, table)]
                a.append(at)
                b.append(at + d)
            x, y = np.concatenate([*a, *b]), np.concatenate([*b, *a])
            meets = np.bincount(x, minlength=len(code))
            order = np.lexsort((node[y], meets[y], x))
            x, y = x[order], y[order]
            best = np.append(x[1:] != x[:-1], True)[: len(x)]
            x, y = x[best], y[best]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[x].view(np.int64)), pa.array(fp[x].view(np.int64)), pa.array(node[x]), pa.array(node[y])], ["bucket", "fp", "node", "best"])
            fuller = np.unique(bucket[WINDOW + 1 :][bucket[WINDOW + 1 :] == bucket[: -WINDOW - 1]]).view(np.int64)
            none = pa.nulls(len(fuller), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fuller), none, none, none], ["bucket", "fp", "node", "best"])
            tail = np.stack([code[-WINDOW - 1 :], node[-WINDOW - 1 :]])

    return _dealt(rows, _bucket(F.col("code"))).sortWithinPartitions("code", "node").mapInArrow(run, "bucket long, fp long, node long, best long")


def _other_pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): near pairs of different groups among the found rows of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([tail, [batch.column(c).to_numpy() for c in ("bucket", "fp", "node", "near")]], axis=1)
            rows = rows[:, np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))[: rows.shape[1]]]
            bucket, fp, node, near = rows
            fp, table = fp.view(np.uint64), pivot_table(fp.view(np.uint64))
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, min(WINDOW, len(node) - 1) + 1):
                same = bucket[d:] == bucket[:-d]
                if not same.any():
                    break
                apart = np.flatnonzero(same & (near[d:] != near[:-d]))
                at = apart[near_pairs(fp, apart, apart + d, RADIUS, table)]
                u.append(np.maximum(node[at], node[at + d]))
                v.append(np.minimum(node[at], node[at + d]))
            pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])
            tail = rows[:, -WINDOW - 1 :]

    named = found.join(groups, "node", "left").select("bucket", "fp", "node", F.coalesce("near", "node").alias("near"))
    return _dealt(named, F.col("bucket")).sortWithinPartitions("bucket", "fp", "node").mapInArrow(run, "u long, v long").distinct()


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that may be similar by their sizes and whole fingerprints."""
    u, v = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("print").alias(f"{c}_print")) for c in "uv")
    differ = F.lit(0)
    for i in range(BITS // 64):
        differ = differ + F.bit_count(F.col("u_print")[i].bitwiseXOR(F.col("v_print")[i]))
    apart = F.when(F.greatest("u_size", "v_size") > BRIEF, APART).otherwise(BRIEF_APART)
    return pairs.join(u, "u").join(v, "v").filter(could_be_similar(F.col("u_size"), F.col("v_size")) & (differ <= apart)).select(pairs.columns)


def _verified(members: DataFrame) -> DataFrame:
    """(u, v): links that connect what is similar in each group of ``members`` (node, near, size, print, shingles). A group
    is dealt into chunks, so that a text is sent once for each chunk of its group, not for each text."""
    chunks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(members.groupBy("near").agg(chunks.alias("chunks")), "near").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"p": F.least("chunk", "other"), "q": F.greatest("chunk", "other")})

    def run(held: pa.Table) -> pa.Table:
        node, size, chunk = (held[c].to_numpy() for c in ("node", "size", "chunk"))
        prints = np.stack([x.values.to_numpy().view(np.uint64) for x in held["print"]])
        sets = [x.values.to_numpy().view(np.uint64) for x in held["shingles"]]
        p, q = held["p"][0].as_py(), held["q"][0].as_py()
        left, right = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
        may = np.zeros((len(node), len(node)), bool)
        for k in left:
            low, high = np.minimum(size[right], size[k]), np.maximum(size[right], size[k])
            apart = np.bitwise_count(prints[right] ^ prints[k]).sum(1, dtype=np.int64)
            may[k, right] = (apart <= np.where(high > BRIEF, APART, BRIEF_APART)) & (SIMILAR[1] * low >= SIMILAR[0] * high) & (right != k)
        may |= may.T
        linked, u, v = np.arange(len(node)), [], []
        for k in np.argsort(-may.sum(1), kind="stable"):  # what most are near to is likely to link most
            others = np.flatnonzero(may[k] & (linked != linked[k]))
            may[k], may[:, k] = False, False
            for m in others[similar(sets[k], [sets[m] for m in others])] if len(others) else ():
                if linked[m] != linked[k]:
                    linked[linked == linked[m]] = linked[k]
                    u.append(max(node[k], node[m]))
                    v.append(min(node[k], node[m]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sent.select("near", "p", "q", "chunk", "node", "size", "print", "shingles").groupBy("near", "p", "q").applyInArrow(run, "u long, v long")


def _fuller_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): near pairs of different groups in the buckets of ``rows``. Of a bucket's groups the largest only answers."""
    named = rows.join(groups.withColumnRenamed("near", "root"), "node", "left").select("bucket", "fp", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("bucket", F.col("top.root").alias("top"))
    both = named.join(mixed, "bucket").select("*", *(p.alias(f"p{i}") for i, p in enumerate(pivot_distances(F.col("fp")))))
    a, b = both.filter("root <> top").alias("a"), both.alias("b")
    apart = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.top")) | (F.col("a.node") < F.col("b.node")))
    return a.join(b, apart & near("a", "b", RADIUS)).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` with their texts' shingles, as 64-bit hashes. A Bloom filter of the nodes keeps
    other texts from being cut up; what it lets pass in vain, the join drops."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in byte_chunks(batches):
            words = [joined(t) for t in texts]
            named = np.array([_node(w) for w in words], np.int64)
            at = np.flatnonzero(may_hold(sent.value, named.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(named[at]), pa.array([shingle_set(words[i]).view(np.int64) for i in at], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]).join(nodes, "node")


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _near_groups(nodes: DataFrame) -> Stored:
    """(node, near): the texts that have a near one, with their group's least node, which itself has no row."""
    rows = _rows(nodes, key_bits(nodes.count()))
    found = store(_found(rows), "copies-found")
    near = found.df.filter(F.col("node").isNotNull())
    asked = store(near.select(*_pair("node", "best")).distinct(), "copies-asked")
    first = components(_alike(asked.df, nodes))
    groups = first.df.toDF("node", "near")
    others = _other_pairs(near, groups)
    fuller = found.df.filter(F.col("node").isNull()).select("bucket").distinct()
    full = None
    if not fuller.isEmpty():
        rest = F.col("code").bitwiseAND(F.lit((1 << REST) - 1))
        full = store(rows.select(_bucket(F.col("code")).alias("bucket"), rest.alias("fp"), "node").join(fuller, "bucket"), "copies-full")
        others = others.unionByName(_fuller_pairs(full.df, groups)).distinct()
    joins = store(_alike(others.join(asked.df, ["u", "v"], "left_anti"), nodes), "copies-joins")
    whole = first if joins.df.isEmpty() else components(first.df.unionByName(joins.df))
    for held in (found, asked, joins, *([full] if full else []), *([first] if whole is not first else [])):
        held.drop()
    return Stored(whole.df.toDF("node", "near"), whole.path)


def _links(plain: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): verified links that connect what is similar."""
    groups = _near_groups(nodes)
    inside = groups.df.unionByName(groups.df.select(F.col("near").alias("node"), "near").distinct())
    sets = store(_sets(plain, inside), "copies-sets")
    links = store(_verified(sets.df.join(nodes, "node")), "copies-links").df
    for held in (groups, sets):
        held.drop()
    return links


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, node, root) of each row: rows of one root are linked."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    marked = store(_marked(plain), "copies-marked")
    nodes = store(marked.df.select("node", "size", "print").dropDuplicates(["node"]), "copies-nodes")
    roots = components(_links(plain, nodes.df)).df.toDF("node", "root")
    nodes.drop()
    return marked.df.select("id", "tid", "node").join(roots, "node", "left").select("id", "tid", "node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and component_id, the least id reachable over links.

    Null, empty and wordless texts are equal texts. Repeated rows stay; a null id never names a component unless all
    its ids are null. An empty table gives an empty result. Other columns are not read.
    """
    rooted = _grouped(docs, id_col, text_col)
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(named, "root").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of least id (null ids last), of equal ids that of
    least text hash. Different texts that share an id, or have none, stay unless they are near copies; of rows that are
    equal in id and text the one stays whose other columns, of any type, are least as JSON text."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no column is called like one used here
    id_, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    least = F.struct(F.col("id").isNull().alias("none"), "id", "tid")
    grouped = _grouped(plain.select(id_.alias("doc_id"), text.alias("text")), "doc_id", "text")
    first = grouped.groupBy("root").agg(F.min(least).alias("x")).select(F.col("x.id").alias("first_id"), F.col("x.tid").alias("first_tid"))
    held = plain.select(id_.alias("id"), F.xxhash64(text).alias("tid"), F.struct(*plain.columns).alias("row"), F.to_json(F.struct(*plain.columns)).alias("said"))
    kept = held.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tid") == F.col("first_tid")), "left_semi")
    return kept.groupBy("id", "tid").agg(F.min_by("row", "said").alias("row")).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
