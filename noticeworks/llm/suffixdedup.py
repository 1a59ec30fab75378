"""Removal of repeated byte strings, by a distributed difference-cover suffix algorithm.

The text to sort is first narrowed, without loss. The anchor of a string of LENGTH bytes is its least gram by hash, so
equal strings have equal anchors, at equal places. An anchor's context is the run of strings that it anchors.

* Strings whose anchor gram stands nowhere else occur once.
* A context that also occurs earlier is repeated as a whole, and its strings need no further look.
* Of a gram with one context, the first occurrence is all that stays.

Every other context goes to the suffix algorithm, however many its gram has. Places are counted from the anchor, so
equal strings stand at equal places, and a cover needs a common sampled shift for such pairs only: every STEP-th place
before the anchor is sampled (STEP = LENGTH - 81, one place in 19).

1. Sort the triples of LETTER-byte letters at the sampled places and name them by rank.
2. Recurse on the names: the triple of names at a sampled place, sorted and named again, covers 81 bytes. A name that
   only one place has ends the matter for all strings that run through it.
3. Merge the remaining suffixes: each string is ordered by its next sampled place's name and by the bytes before and
   behind the 81.
4. Compare neighbours in that order, across the partitions' edges: equal strings stand together, in the order of their
   documents and places, and all but the first are repeats.

The names compare bytes; only whole contexts are taken as equal by hash (64 bits for the gram, 64 for the context).
No hot gram, context or string is brought into one task: groups are aggregated, joined with skew handling, or sorted
by ranges that cut through them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, byte_chunks, may_hold, runs, store
from .wordhash import mix, powers

LENGTH, GRAM, LETTER = 100, 32, 9
#: Bytes that a triple of letters and a triple of names cover.
TRIPLE, COVER = 3 * LETTER, 9 * LETTER
#: Bytes whose anchors are found together; longest piece of a text.
BLOCK, SEGMENT = 1 << 18, 1 << 22
_AT_BITS = np.uint64(24)
_CONTEXT = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, bytes) of about BLOCK bytes; each string of ``length`` bytes lies in one piece."""
    cut = [(i, at, t[at : at + SEGMENT + length - 1] if len(t) > SEGMENT else t) for i, t in enumerate(texts) for at in range(0, len(t) - length + 1, SEGMENT)]
    for a, b in runs(np.array([len(x[2]) for x in cut], np.int64), BLOCK):
        yield tuple(map(list, zip(*cut[a:b], strict=True)))  # type: ignore[misc]


def contexts_of(texts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """The contexts of the texts, in order: text, lo (its first string), n (strings), off (the anchor's place after
    lo), gram and ctx (hashes of the anchor's gram and of the whole context)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "lo", "n", "off", "gram", "ctx")}
    for numbers, offsets, parts in _pieces(texts, length):
        buf = np.frombuffer(b"".join(parts), np.uint8)
        power, inverse = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_values()[buf] * power[:-1], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(buf) - GRAM + 1])
        least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, size = length - GRAM + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(grams) - width + 1], least[width - size :][: len(grams) - width + 1])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        # Strings that cross the end of a piece are none.
        end = np.cumsum([len(x) for x in parts])
        crossing = np.zeros(len(at) + 1, np.int32)
        np.add.at(crossing, np.minimum(np.maximum(end - length + 1, 0), len(at)), 1)
        np.add.at(crossing, np.minimum(end, len(at)), -1)
        whole = np.cumsum(crossing[:-1]) == 0
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~whole[:-1] | ~whole[1:]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        first, n = first[whole[first]], n[whole[first]]
        piece = np.searchsorted(end, first, side="right")
        off = at[first] - first
        ctx = mix((total[first + n - 1 + length] - total[first]) * inverse[first] + n.astype(np.uint64) * _CONTEXT[0] + off.astype(np.uint64) * _CONTEXT[1])
        start = end - np.array([len(x) for x in parts])
        for k, v in (("text", np.array(numbers)[piece]), ("lo", first - start[piece] + np.array(offsets)[piece]), ("n", n), ("off", off), ("gram", grams[at[first]]), ("ctx", ctx)):
            out[k].append(v)
    none = {"gram": np.uint64, "ctx": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, none.get(k, np.int64)) for k, v in out.items()}


def repeated_grams(docs: DataFrame, text_col: str, length: int) -> np.ndarray:
    """A Bloom filter that holds every anchor gram with two or more contexts."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in byte_chunks(batches, text_col):
            h, n = np.unique(contexts_of(texts, length)["gram"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

    counted = docs.select(text_col).mapInArrow(grams, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    held = store(counted, "suffix-grams")
    words = bloom_filter(held.df, "gram")
    held.drop()
    return words


def tid(text_col: str) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def repeated_contexts(docs: DataFrame, bloom: np.ndarray, id_col: str, text_col: str, length: int) -> DataFrame:
    """(gram, ctx, id, tid, lo, n, off): contexts whose gram may have another."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            words, c = sent.value, contexts_of(texts, length)
            may = may_hold(words, c["gram"])
            take = pa.array(c["text"][may])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["gram"][may].view(np.int64)), pa.array(c["ctx"][may].view(np.int64)), batch.column("id").take(take), batch.column("tid").take(take), pa.array(c["lo"][may]), pa.array(c["n"][may].astype(np.int32)), pa.array(c["off"][may].astype(np.int32))],
                ["gram", "ctx", "id", "tid", "lo", "n", "off"],
            )

    rows = docs.select(F.col(id_col).alias("id"), tid(text_col).alias("tid"), text_col)
    return rows.mapInArrow(find, f"gram long, ctx long, id {dict(docs.dtypes)[id_col]}, tid long, lo long, n int, off int")


def _with_bytes(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(id, tid, lo, n, off, data): contexts with their bytes."""
    by_text = reps.groupBy("id", "tid").agg(F.collect_list(F.struct("lo", "n", "off")).alias("reps"))
    texts = docs.select(F.col(id_col).alias("d_id"), tid(text_col).alias("d_tid"), text_col)
    # Rows equal in id and text bring their contexts twice; what follows takes them as one.
    joined = by_text.join(texts, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("tid") == F.col("d_tid"))).select("id", "tid", "reps", text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            reps = batch.column("reps")
            rows = reps.flatten()
            source = np.repeat(np.arange(len(reps)), [len(x) for x in reps])
            lo, n = (rows.field(c).to_numpy() for c in ("lo", "n"))
            data = [texts[i][a : a + k - 1 + length] for i, a, k in zip(source.tolist(), lo.tolist(), n.tolist(), strict=True)]
            take = pa.array(source)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tid").take(take), rows.field("lo"), rows.field("n"), rows.field("off"), pa.array(data, pa.binary())], ["id", "tid", "lo", "n", "off", "data"])

    return joined.mapInArrow(cut, f"id {dict(docs.dtypes)[id_col]}, tid long, lo long, n int, off int, data binary")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, start of each value among them) of a binary column without nulls."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), start[:-1]


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for the numbers first, first + 1, ... of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def _named(rows: DataFrame) -> DataFrame:
    """(key, name) of the keys that several rows have: the rank of each, as its sorted partition's number above its
    place there."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.arange(at, at + batch.num_rows))], ["key", "name"])
            at += batch.num_rows

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return several.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(rank, f"key {dict(rows.dtypes)['key']}, name long")


def sampled_names(frags: DataFrame, length: int = LENGTH) -> DataFrame:
    """(frag, k, name): the rank of the COVER bytes from the place k steps before the anchor, where several have them."""
    step = length - COVER

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start = _bytes_of(batch.column("data"))
            n, off = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "off"))
            first = (off - n + 1) // step
            row, k = _ranges(first, off // step - first + 1)
            # A third of the cover each.
            at = (start[row] + off[row] - k * step)[:, None] + TRIPLE * np.arange(3)
            key = np.ascontiguousarray(data[at.reshape(-1, 1) + np.arange(TRIPLE)])
            ends = np.arange(0, key.size + 1, TRIPLE, dtype=np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(key)])
            part = np.tile(np.arange(3, dtype=np.int32), len(row))
            yield pa.RecordBatch.from_arrays([batch.column("frag").take(pa.array(np.repeat(row, 3))), pa.array(np.repeat(k.astype(np.int32), 3)), pa.array(part), keys], ["frag", "k", "part", "key"])

    rows = store(frags.select("frag", "n", "off", "data").mapInArrow(triples, "frag long, k int, part int, key binary"), "suffix-triples")
    named = store(rows.df.join(_named(rows.df), "key").select("frag", "k", "part", "name"), "suffix-names")
    rows.drop()
    third = [F.max(F.when(F.col("part") == i, F.col("name"))).alias(c) for i, c in enumerate("abc")]
    again = named.df.groupBy("frag", "k").agg(*third).filter("a is not null and b is not null and c is not null")
    again = store(again.select("frag", "k", F.struct(*"abc").alias("key")), "suffix-again")
    named.drop()
    out = store(again.df.join(_named(again.df), "key").select("frag", "k", "name"), "suffix-names").df
    again.drop()
    return out


def repeats(frags: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, tid, p): strings of ``length`` bytes that also start earlier.

    ``frags`` has id, tid, lo, n, off, data and frag, a number for each row."""
    spark, step = frags.sparkSession, length - COVER
    if step < 1:
        raise ValueError(f"length must be at least {COVER + 1}")
    names = sampled_names(frags, length).groupBy("frag").agg(F.collect_list(F.struct("k", "name")).alias("names"))
    together = frags.join(names, "frag").select("id", "tid", "lo", "n", "off", "data", "names")
    words = [f"w{i}" for i in range(-(-(step + 1) // 8))]  # the bytes around the cover, eight to a number
    kind = dict(frags.dtypes)["id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("names")
            source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            flat = lists.flatten()
            k, name = flat.field("k").to_numpy().astype(np.int64), flat.field("name").to_numpy()
            data, start = _bytes_of(batch.column("data"))
            lo, n, off = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "n", "off"))
            least = np.maximum(k * step, (off - n + 1)[source])
            for a, b in runs(np.minimum(k * step + step - 1, off[source]) - least + 1, 1 << 15):
                sampled, place = _ranges(least[a:b], (np.minimum(k * step + step - 1, off[source]) - least + 1)[a:b])
                sampled += a
                row = source[sampled]
                at, shift = off[row] - place, place - k[sampled] * step
                j = np.arange(step)
                around = np.zeros((len(row), 8 * len(words)), np.uint8)
                around[:, 0] = shift
                around[:, 1 : step + 1] = data[(start[row] + at)[:, None] + j + COVER * (j >= shift[:, None])]
                packed = around.view(np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tid").take(take), pa.array(lo[row] + at), pa.array(name[sampled]), *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(words)))], ["id", "tid", "p", "name", *words])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail = TaskContext.get().partitionId(), None, None

        def edge(row: pa.RecordBatch, end: bool) -> list[pa.Array]:
            key = [row.column(c)[0].as_py() for c in ("name", *words)]
            return [*row.select(place).columns, pa.array([part], pa.int32()), pa.array([key], pa.list_(pa.int64())), pa.array([end])]

        for batch in batches:
            if not batch.num_rows:
                continue
            if tail:  # the row that opened the last batch's last key
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            head = head or batch.slice(0, 1)
            key = np.stack([batch.column(c).to_numpy() for c in ("name", *words)])
            new = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))
            opened = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            tail = batch.slice(int(opened[-1]), 1)
            # A repeated row of the table brings the key's first string once more.
            other = np.zeros(len(new), bool)
            for c in place:
                column, first = batch.column(c), batch.column(c).take(pa.array(opened))
                other |= ~pc.fill_null(pc.equal(column, first), False).to_numpy(zero_copy_only=False) & ~(pc.is_null(column).to_numpy(zero_copy_only=False) & pc.is_null(first).to_numpy(zero_copy_only=False))
            later = batch.select(place).filter(pa.array(other))
            none = (pa.nulls(later.num_rows, t) for t in (pa.int32(), pa.list_(pa.int64()), pa.bool_()))
            yield pa.RecordBatch.from_arrays([*later.columns, *none], [*place, "part", "key", "end"])
        if head:
            for row, end in ((head, False), (tail, True)):
                yield pa.RecordBatch.from_arrays(edge(row, end), [*place, "part", "key", "end"])

    parts, place = int(spark.conf.get("spark.sql.shuffle.partitions")), ["id", "tid", "p"]
    order = ["name", *words, *place]
    suffixes = together.mapInArrow(merge, f"id {kind}, tid long, p long, name long, " + ", ".join(f"{w} long" for w in words))
    ordered = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = store(ordered.mapInArrow(neighbours, f"id {kind}, tid long, p long, part int, key array<long>, end boolean"), "suffix-later").df
    # Each partition's first string is a repeat if a partition before opened its key. Two rows of a partition come here.
    on, key, opener = [], None, None
    for row in found.filter("part is not null").orderBy("part", "end").collect():
        if row["key"] != key:
            key, opener = row["key"], (row["id"], row["tid"], row["p"])
        elif not row["end"] and (row["id"], row["tid"], row["p"]) != opener:
            on.append(row["part"])
    return found.filter(F.col("part").isNull() | (~F.col("end") & F.col("part").isin(on))).select(*place)


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, tid, spans): the maximal byte ranges [from, to) covered by strings of ``length`` bytes that also start
    earlier: in a text of smaller id, or earlier in the same text. Texts without such a range have no row. A null id is
    earlier than all; texts that share an id are in order of their hash, and rows equal in both are one."""
    id_type = dict(docs.dtypes)[id_col]
    bloom = repeated_grams(docs, text_col, length)
    found = store(repeated_contexts(docs, bloom, id_col, text_col, length), "suffix-contexts")
    first = found.df.groupBy("gram", "ctx").agg(F.min(F.struct("id", "tid", "lo", "n", "off")).alias("first"), F.count("*").alias("rows"))
    first = store(first, "suffix-first")
    here = F.struct("id", "tid", "lo")
    later = found.df.join(first.df.filter("rows > 1").select("gram", "ctx", "first"), ["gram", "ctx"]).filter(F.struct("first.id", "first.tid", "first.lo") < here).select("id", "tid", "lo", "n")
    whole = store(later, "suffix-whole")
    found.drop()
    # Written, so that the join deals both sides itself and can split a gram of very many contexts.
    several = store(first.df.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("gram"), "suffix-several")
    reps = first.df.join(several.df, "gram").select("first.*")
    contested = store(_with_bytes(reps, docs, id_col, text_col, length).withColumn("frag", F.monotonically_increasing_id()), "suffix-contested")
    for held in (first, several):
        held.drop()
    sorted_out = repeats(contested.df, length).select("id", "tid", F.col("p").alias("lo"), F.lit(1).alias("n"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, n in zip(batch.column("lo"), batch.column("n"), strict=True):
                lo, n = lo.values.to_numpy(), n.values.to_numpy()
                by = np.argsort(lo, kind="stable")
                lo, end = lo[by], np.maximum.accumulate((lo + n)[by]) + length - 1
                gap = np.flatnonzero(lo[1:] > end[:-1])  # ranges that touch are one
                out.append([{"from": int(a), "to": int(b)} for a, b in zip(lo[np.append(0, gap + 1)], end[np.append(gap, len(lo) - 1)], strict=True)])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tid"), pa.array(out, kind)], ["id", "tid", "spans"])

    removed = whole.df.unionByName(sorted_out).groupBy("id", "tid").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    return removed.mapInArrow(spans, f"id {id_type}, tid long, spans array<struct<from:long,to:long>>")


def with_spans(docs: DataFrame, name: str = "spans", *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the column ``name`` (empty where nothing repeats)."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no column is called like one used here
    id_, text = (plain[f"c{docs.columns.index(c)}"] for c in (id_col, text_col))
    spans = store(removed_spans(plain.select(id_.alias("doc_id"), text.alias("text")), length=length), "suffix-spans").df
    spans = spans.withColumnsRenamed({"id": "span_id", "tid": "span_tid", "spans": "found_spans"})
    own = plain.withColumn("own_tid", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = own.join(spans, id_.eqNullSafe(spans["span_id"]) & (own["own_tid"] == spans["span_tid"]), "left")
    none = F.array().cast("array<struct<from:long,to:long>>")
    return joined.select(*(plain[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)), F.coalesce("found_spans", none).alias(name))


def kept(raw: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["from"]])
        at = s["to"]
    return b"".join([*out, raw[at:]])


def removal_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that stay).

    Null texts are empty; texts shorter than ``length`` keep all. Repeated rows stay and are judged alike; an empty
    table gives an empty result; other columns are not read."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            rest = [kept(t, s) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            left = np.fromiter(map(len, rest), np.int64, len(rest))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(size), pa.array(size - left), pa.array([len(s) for s in batch.column("spans")], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rest])], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = with_spans(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, length=length)
    return marked.mapInArrow(report, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts. A character that is only partly covered stays whole.

    Null texts stay null; other columns, whatever their names, stay as they are."""
    schema, marks = docs.schema, "spans" + "_" * max(map(len, docs.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            out = []
            for raw, found, spans in zip(texts, batch.column(text_col).is_valid().to_pylist(), batch.column(marks).to_pylist(), strict=True):
                for s in spans:
                    while s["from"] < len(raw) and raw[s["from"]] & 0xC0 == 0x80:
                        s["from"] += 1
                    while s["to"] < len(raw) and raw[s["to"]] & 0xC0 == 0x80:
                        s["to"] -= 1
                out.append(kept(raw, spans).decode("utf-8", "replace") if found else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in schema.names], schema.names)

    return with_spans(docs, marks, id_col=id_col, text_col=text_col, length=length).mapInArrow(cut, schema)
