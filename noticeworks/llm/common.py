"""What the corpus operators share: the shared scratch folder, row splits and byte batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.tables import Stored, drop_path, new_path, shared_dir, store

from .wordhash import mix

__all__ = ["Stored", "bloom_filter", "byte_chunks", "drop_path", "fold", "may_hold", "new_path", "pieces", "runs", "shared_dir", "store"]

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 1 << 20
#: Bits of a Bloom filter: at least, at most, for each value.
BLOOM_LEAST, BLOOM_MOST, BLOOM_EACH = 1 << 20, 1 << 29, 16


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def runs(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into ranges of about ``most`` bytes; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def byte_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 bytes (null: empty), each of about CHUNK_BYTES."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, j in runs(sizes):
            yield batch.slice(i, j - i), [x or b"" for x in column.slice(i, j - i).to_pylist()]


def pieces(text: bytes, word: re.Pattern[bytes]) -> Iterator[bytes]:
    """Pieces of about CHUNK_BYTES of a text that cut none of its longest matches of ``word``."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        if rest := word.match(text, end):
            end = rest.end()
        yield text[at:end]
        at = end
    yield text[at:]


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a hash in a Bloom filter of ``bits`` (a power of two)."""
    x, y = mix(h), mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    return [(v & np.uint64(bits - 1)).astype(np.int64) for v in (x, x >> np.uint64(32), y)]


def bloom_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Words of a Bloom filter of the 64-bit hashes in ``column``. Its size follows their number up to BLOOM_MOST bits;
    beyond that it lets more pass, which costs rows and no result. ``hashes`` is read twice."""
    want = max(1, hashes.count() * BLOOM_EACH)
    bits = min(max(1 << (want - 1).bit_length(), BLOOM_LEAST), BLOOM_MOST)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bits"])

    rows = hashes.select(column).mapInArrow(places, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    may = np.ones(len(hashes), bool)
    for at in _places(hashes, len(words) << 6):
        may &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return may
