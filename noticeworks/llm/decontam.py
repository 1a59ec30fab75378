"""Benchmark decontamination: a BM25 index of test items with block-max bounds, queried by every training passage.

Passages overlap by half and are as long as two of the longest items, so an item that a text repeats lies whole in one
of them. Impacts are BM25 weights divided by the item's own total: a passage that holds all of an item's words scores
1. As in WAND, a passage is dropped as soon as an upper bound falls below the threshold: first the sum of its words'
greatest impacts, then, for each block of items, the sum of the block's greatest impacts, and only then is an item
scored. The bounds of many passages are taken together. Every item above the threshold is then verified: its question
and its answer must each share most of their word shingles with the text.

Items are dealt over shards by their hash. Tasks build the shards' indexes and write them to the shared folder; a task
that reads texts holds many of them at a time and goes through the shards one after another, so the corpus is scanned
once, and neither the driver nor a task holds more than one shard's index.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_chunks, new_path
from .warczip import arrow_uri
from .wordhash import hash_words, mix

K1, B = 1.2, 0.75
#: Least share of an item's weight; least share of the shingles of question and answer; words in a shingle.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Impacts of an item's commonest words, up to this share, count as given: such words need no lookup.
GIVEN = 0.2
BLOCK_ITEMS, LEAST_WINDOW = 16, 64
#: Bytes of items in a shard: an index takes some ten times as much. Bytes of an index in a row of its table.
SHARD_BYTES, PIECE_BYTES = 8 << 20, 4 << 20
#: Bytes of texts that meet a shard at a time.
HELD_BYTES = 32 << 20
_SENTENCE = re.compile(rb"(?<=[.!?])\s+")


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = words[: n - size + 1].copy()
    for k in range(1, size):
        out = mix(out) + words[k : n - size + 1 + k]
    return mix(out)


def question_answer(text: bytes) -> tuple[bytes, bytes]:
    """The last sentence is the answer; of a single sentence, the last third of the words."""
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return b" ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return b" ".join(words[:cut]), b" ".join(words[cut:])


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass
class ItemIndex:
    """Postings of one shard of items, by term; a term's block postings hold its greatest impact in each block."""

    item_ids: list
    times: list[int]  # how often an item is given
    terms: np.ndarray  # sorted hashes
    most: np.ndarray  # greatest impact of each term
    first: np.ndarray  # postings of term t: first[t] to first[t + 1]
    items: np.ndarray
    impacts: np.ndarray
    block_first: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    window: int
    keys: list[tuple[np.ndarray, np.ndarray]]  # shingle hashes of question and answer
    sizes: list[tuple[int, int]]  # words in these shingles
    weights: list[tuple[np.ndarray, np.ndarray]]  # all terms of each item and their shares of its weight


@dataclass
class ItemStatistics:
    """Of all items that have a word: how many, their mean number of words, and in how many each term stands."""

    n: int
    mean: float
    terms: np.ndarray  # sorted hashes
    df: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """(shard, words, term): of rows (shard, item_text), one for each item with its number of words, and one for each
    of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, "item_text"):
            hashes, words = hash_words(texts)
            own = [np.unique(w) for w in np.split(hashes, np.cumsum(words)[:-1])]
            shard = batch.column("shard").to_numpy()
            shards = np.concatenate([shard[words > 0], np.repeat(shard, list(map(len, own)))])
            count, terms = words[words > 0].tolist(), np.concatenate(own).view(np.int64).tolist()
            columns = [pa.array(shards.astype(np.int32)), pa.array([*count, *[None] * len(terms)], pa.int64()), pa.array([*[None] * len(count), *terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "words", "term"])

    return items.select("shard", "item_text").mapInArrow(run, "shard int, words long, term long")


def build_index(item_ids: list, texts: list[bytes], known: ItemStatistics, times: list[int] | None = None) -> ItemIndex:
    """The index of a shard by the statistics of all items. Items without a word are left out."""
    times = times or [1] * len(item_ids)
    hashes, words = hash_words(texts)
    own = np.split(hashes, np.cumsum(words)[:-1]) if len(texts) else []
    keep = [i for i, w in enumerate(own) if len(w)]
    item_ids, times, texts, own = ([x[i] for i in keep] for x in (item_ids, times, texts, own))
    # Items of one vocabulary share blocks, which keeps the blocks' bounds tight.
    order = sorted(range(len(own)), key=lambda i: (int(np.bincount((own[i] >> np.uint64(58)).astype(int), minlength=64).argmax()), int(own[i].min())))
    item_ids, times, texts, own = ([x[i] for i in order] for x in (item_ids, times, texts, own))
    n, mean, terms = len(own), known.mean, known.terms
    counted = [np.unique(w, return_counts=True) for w in own]
    idf = np.log1p((known.n - known.df + 0.5) / (known.df + 0.5))
    weights = []
    t_all, i_all, x_all = [], [], []
    for i, (t, tf) in enumerate(counted):
        at = np.searchsorted(terms, t)
        weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own[i]) / mean))
        weight = weight / weight.sum()
        weights.append((t, weight))
        # The lightest words, up to GIVEN in all, are taken as present.
        light = np.argsort(weight, kind="stable")
        given = light[np.cumsum(weight[light]) <= GIVEN]
        stay = np.setdiff1d(np.arange(len(t)), given)
        t_all.append(at[stay])
        i_all.append(np.full(len(stay), i))
        x_all.append(weight[stay])
    t_all, i_all, x_all = (np.concatenate(x) if n else np.zeros(0, int) for x in (t_all, i_all, x_all))
    used, t_all = np.unique(t_all, return_inverse=True)
    by = np.lexsort((i_all, t_all))
    t_all, i_all, x_all = t_all[by], i_all[by].astype(np.int64), x_all[by].astype(np.float64)
    first = np.searchsorted(t_all, np.arange(len(used) + 1))
    pair = t_all * (n // BLOCK_ITEMS + 1) + i_all // BLOCK_ITEMS
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
    block_most = np.maximum.reduceat(x_all, at) if len(at) else x_all
    parts = [question_answer(t) for t in texts]
    keys, sizes = [], []
    for q, a in parts:
        h, w = hash_words([q, a])
        keys.append((distinct(shingle_hashes(h[: w[0]])), distinct(shingle_hashes(h[w[0] :]))))
        sizes.append((min(SHINGLE, int(w[0])), min(SHINGLE, int(w[1]))))
    return ItemIndex(
        item_ids, times, terms[used], np.maximum.reduceat(x_all, first[:-1]) if len(used) else x_all, first, i_all, x_all, np.searchsorted(t_all[at], np.arange(len(used) + 1)), i_all[at] // BLOCK_ITEMS, block_most,
        max([LEAST_WINDOW, *map(len, own)]), keys, sizes, weights,
    )


def _spread(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entry of ``terms``, posting) for all postings of the terms."""
    n = first[terms + 1] - first[terms]
    source = np.repeat(np.arange(len(terms)), n)
    return source, np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + first[terms][source]


def retrieve(index: ItemIndex, hashes: np.ndarray, words: np.ndarray, threshold: float) -> np.ndarray:
    """(text, item number) of all items that score ``threshold`` or more with any passage of a text."""
    need = threshold - GIVEN - 1e-9
    if not len(index.terms) or not len(hashes):
        return np.zeros((0, 2), np.int64)
    known = np.zeros(1 << 16, bool)
    known[(index.terms >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(known[(hashes >> np.uint64(48)).astype(np.int64)])
    term = np.searchsorted(index.terms, hashes[at])
    found = index.terms[np.minimum(term, len(index.terms) - 1)] == hashes[at]
    at, term = at[found], term[found]
    # Half windows of each text; passage p covers halves p and p + 1.
    begin = np.cumsum(words) - words
    halves = -(-words // index.window)
    half_begin = np.cumsum(halves) - halves
    text = np.searchsorted(begin, at, side="right") - 1
    half = half_begin[text] + (at - begin[text]) // index.window
    n_terms = len(index.terms)
    pair = distinct(np.concatenate([half * n_terms + term, (half - 1)[half > half_begin[text]] * n_terms + term[half > half_begin[text]]]))
    passage, term = pair // n_terms, pair % n_terms
    bound = np.bincount(passage, weights=index.most[term], minlength=1)
    live = bound[passage] >= need
    passage, term = passage[live], term[live]
    if not len(passage):
        return np.zeros((0, 2), np.int64)
    n_blocks = int(index.blocks.max()) + 1
    # Block bounds, then items of the blocks that pass.
    source, post = _spread(index.block_first, term)
    key = passage[source] * n_blocks + index.blocks[post]
    keys, code = np.unique(key, return_inverse=True)
    good = keys[np.bincount(code, weights=index.block_most[post]) >= need]
    if not len(good):
        return np.zeros((0, 2), np.int64)
    stay = np.isin(passage, good // n_blocks)
    passage, term = passage[stay], term[stay]
    source, post = _spread(index.first, term)
    inside = np.isin(passage[source] * n_blocks + index.items[post] // BLOCK_ITEMS, good)
    source, post = source[inside], post[inside]
    n_items = len(index.item_ids)
    keys, code = np.unique(passage[source] * n_items + index.items[post], return_inverse=True)
    hits = keys[np.bincount(code, weights=index.impacts[post]) >= need]
    texts = np.searchsorted(half_begin, hits // n_items, side="right") - 1
    # With the light words as they are: the item's BM25 score in the passage, of the score that it has in itself.
    good = np.zeros(len(hits), bool)
    for i, (passage, item, text) in enumerate(zip((hits // n_items).tolist(), (hits % n_items).tolist(), texts.tolist(), strict=True)):
        start = begin[text] + (passage - half_begin[text]) * index.window
        own, weight = index.weights[item]
        good[i] = weight[np.isin(own, hashes[start : min(start + 2 * index.window, begin[text] + words[text])])].sum() >= threshold - 1e-9
    hits, texts = hits[good], texts[good]
    # Texts without words have no halves and share the next one's start.
    return np.unique(np.stack([texts, hits % n_items], axis=1), axis=0)


def store_indexes(items: DataFrame, shards: int, *, item_id: str, item_text: str) -> list[list[str]]:
    """Files of each shard's index in the shared folder. An item that is given many times is held once."""
    spark = items.sparkSession
    shard = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(shards)).cast("int")
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).filter(F.col("item_text").isNotNull()).withColumn("shard", shard)
    counted = item_terms(rows)
    n, mean = counted.agg(F.count("words"), F.coalesce(F.avg("words"), F.lit(1.0))).first()
    frequency = counted.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    known = counted.filter("term is not null").select("shard", "term").distinct().join(frequency, "term")
    once = rows.groupBy("shard", "item_id", "item_text").agg(F.count("*").alias("times"))

    def build(key: tuple, own: pa.Table, terms: pa.Table) -> pa.Table:
        got = sorted(zip(own["item_id"].to_pylist(), own["item_text"].to_pylist(), own["times"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0], r[1]))
        term = terms["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        index = build_index([r[0] for r in got], [r[1].encode() for r in got], ItemStatistics(n, max(1.0, mean), term[order], terms["df"].to_numpy()[order]), [r[2] for r in got])
        data = pickle.dumps(index, protocol=5)
        parts = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)] if index.item_ids else []
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["shard", "part", "data"])

    path = new_path(spark, "item-indexes")
    schema = "shard int, part int, data binary"
    built = once.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(build, schema)
    built.write.partitionBy("shard").parquet(path)
    files: dict[str, list[str]] = {}
    for name in sorted(spark.read.schema(schema).parquet(path).inputFiles()):
        files.setdefault(name.rsplit("/", 2)[1], []).append(name)
    return list(files.values())


@lru_cache(maxsize=1)
def load_index(files: tuple[str, ...]) -> ItemIndex:
    """A shard's index; a worker keeps the last one."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    parts: dict[int, bytes] = {}
    for name in files:
        where, inner = fs.FileSystem.from_uri(arrow_uri(name))
        with where.open_input_file(inner) as file:
            table = pq.ParquetFile(file).read(columns=["part", "data"])
        parts |= zip(table["part"].to_pylist(), table["data"].to_pylist(), strict=True)
    return pickle.loads(b"".join(parts[k] for k in sorted(parts)))


def leaks(index: ItemIndex, hashes: np.ndarray, words: np.ndarray, threshold: float, least: float) -> Iterator[tuple[int, int, float, float]]:
    """(text, item, share of the question's shingles, of the answer's) of the items that a text repeats."""
    begin = np.cumsum(words) - words
    last, ready = -1, {}
    for text, item in retrieve(index, hashes, words, threshold).tolist():
        if text != last:
            last, ready = text, {}
        shares = []
        for own, size in zip(index.keys[item], index.sizes[item], strict=True):
            if size not in ready:
                ready[size] = distinct(shingle_hashes(hashes[begin[text] : begin[text] + words[text]], size)) if size <= words[text] else np.zeros(0, np.uint64)
            shares.append(float(np.isin(own, ready[size]).mean()) if len(own) else 1.0)
        if min(shares) >= least:
            yield text, item, *shares


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, item id, question_overlap, answer_overlap): a row for each text and item that it repeats.

    Document frequencies and lengths are counted over all items by Spark. Every text is held against every shard of
    about SHARD_BYTES of items, and what is found does not depend on their number. Null texts, texts and items without a
    word match nothing; an item of one part needs only that part. Repeated rows stay; an empty table on either side gives
    an empty result; other columns are not read. The indexes are written at once and read when the result is.
    """
    types, item_type = dict(docs.dtypes), dict(items.dtypes)[item_id]
    arrow_type = to_arrow_type(items.schema[item_id].dataType)
    schema = f"{id_col} {types[id_col]}, {item_id} {item_type}, question_overlap double, answer_overlap double"
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    shards = store_indexes(items, max(1, -(-size // SHARD_BYTES)), item_id=item_id, item_text=item_text)

    def found(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for files in shards:
            index = load_index(tuple(files))
            for ids, hashes, words in held:
                hits = [h for h in leaks(index, hashes, words, threshold, least) for _ in range(index.times[h[1]])]
                if hits:
                    text, item, q, a = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array([index.item_ids[x] for x in item], arrow_type), pa.array(q), pa.array(a)], [id_col, item_id, "question_overlap", "answer_overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, texts in byte_chunks(batches, text_col):
            held.append((batch.column(id_col), *hash_words(texts)))
            size += sum(map(len, texts))
            if size >= held_bytes:
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
