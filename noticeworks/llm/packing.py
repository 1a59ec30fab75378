"""Packing: hierarchical packing of documents into context windows of several lengths.

Whole windows of the longest length are cut off each document; the rest is routed to the smallest tier that holds it.
Tiers are packed from the longest down: a document opens a window, best-fitting shorter documents fill its gap, and
one more is cut to close it. So windows end full; what a task cannot fill is cut down the tiers and padded once.

Ids never leave the task that made them. A task holds the ids of ROUND_TOKENS and one document at most.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_chunks

TIERS = (256, 512, 1024, 2048)
ROUND_TOKENS, STEP_WINDOWS = 4 << 20, 16
END_ID = 1

#: Fixed value: the pre-token pattern of these files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without long runs of white space and without two white spaces at the end: there the last two
#: cases part every white space from the next. Without look-ahead it runs half as fast again.
SHORT_RUNS = PATTERN.removesuffix(r"+(?!\S)|\s+")
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    The vocabulary is read from that file and applied by ``tiktoken``, which gives the same ids several times faster.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        # The format writes a byte that is no visible character as the next free one from 256.
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self._added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take or ask for neighbouring characters are not supported")
        # Of tokens that start at one place the longest counts, as in the library.
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        ranks = {bytes(shown[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self._added}
        self._any, self._short = (tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, SHORT_RUNS))

    def encode(self, text: str) -> np.ndarray:
        """Ids of plain text, in which an added token's name is text like any other."""
        return np.array(array("I", (self._any if _LONG_RUN.search(text) else self._short)(text)), np.uint32)

    def encode_marked(self, text: str) -> np.ndarray:
        """Ids as the library gives them: the name of an added token is that token, and parts the text."""
        if not self._cut or not self._cut.search(text):
            return self.encode(text)
        parts = self._cut.split(text)  # every second one is an added token
        return np.concatenate([np.array([self._added[p]], np.uint32) if i % 2 else self.encode(p) for i, p in enumerate(parts)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Pool:
    """Pieces of fewer ids than the longest window, by length."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths = 0  # bit n: there is a piece of n ids

    def put(self, length: int, doc: int, start: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.lengths &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``; 0 if there is none."""
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.lengths & ((1 << (most + 1)) - 1) else 0

    def shortest(self, least: int) -> int:
        over = self.lengths >> least
        return least + (over & -over).bit_length() - 1 if over else 0


Piece = tuple[int, int, int]  # document, start, length


def pack_tiers(pool: _Pool, tiers: tuple[int, ...], last: bool) -> list[list[Piece]]:
    """Windows from the pool, each filled to a tier's length. What cannot fill one stays in the pool; with ``last``, it
    is cut down the tiers, and the final window may be left short."""
    done: list[list[Piece]] = []
    for size, below in zip(tiers[::-1], (*tiers[-2::-1], 0), strict=True):
        while (n := pool.longest(size)) > below:
            doc, start = pool.take(n)
            window, gap = [(doc, start, n)], size - n
            while gap and (n := pool.longest(gap) or pool.shortest(gap + 1)):
                doc, start = pool.take(n)
                used = min(n, gap)
                if n > used:
                    pool.put(n - used, doc, start + used)
                window.append((doc, start, used))
                gap -= used
            if not gap:
                done.append(window)
                continue
            # The pool is empty: cut this window down the shorter tiers, and carry or pad the rest.
            pieces = window[::-1]
            total = size - gap
            for tier in tiers[::-1]:
                while total >= tier:
                    window, room = [], tier
                    while room:
                        doc, start, n = pieces.pop()
                        used = min(n, room)
                        if n > used:
                            pieces.append((doc, start + used, n - used))
                        window.append((doc, start, used))
                        room -= used
                    done.append(window)
                    total -= tier
            if total and last:
                done.append(pieces[::-1])
            elif total:
                for doc, start, n in pieces:
                    pool.put(n, doc, start)
            return done
    return done


def _step_groups(sizes: list[int], window: int) -> np.ndarray:
    """Deal windows, longest first and to and fro, to groups of about STEP_WINDOWS long windows."""
    n = max(1, round(sum(sizes) / (window * STEP_WINDOWS)))
    order = np.argsort(-np.array(sizes), kind="stable")
    turn, place = np.divmod(np.arange(len(sizes)), n)
    group = np.empty(len(sizes), np.int64)
    group[order] = np.where(turn % 2, n - 1 - place, place)
    return group


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def pack_documents(docs: DataFrame, tokenizer: str, *, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id and COLUMNS.

    ``tokenizer`` is the path of a byte-level BPE file on every executor. Names of its added tokens in a text are those
    tokens, as in the library. Each text's ids (null: none) end with END_ID.
    ``sequence_id`` numbers windows, ``offset`` the ids before the piece in its window; ``sequence_length`` is the
    padded length: a window that ends at a power of two is not padded, any other to the longest tier. ``step_group``
    names a set of windows of about the same sum of ids. Repeated rows are packed as often; an empty table gives an
    empty result; other columns are not read.
    """
    if list(tiers) != sorted({*tiers}) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    longest = tiers[-1]
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer).encode_marked, TaskContext.get().partitionId() << 40
        names, ids, held, pool = [], {}, 0, _Pool()
        whole: list[list[Piece]] = []
        sequences = groups = 0
        id_type = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal whole, held, sequences, groups, ids
            windows = whole + pack_tiers(pool, tiers, last)
            sizes = [sum(p[2] for p in w) for w in windows]
            group = _step_groups(sizes, longest) + groups if windows else np.zeros(0, np.int64)
            rows = []
            for i, (window, size) in enumerate(zip(windows, sizes, strict=True)):
                offset, padded = 0, size if size & (size - 1) == 0 else longest
                for doc, start, n in window:
                    own = ids[doc]
                    rows.append((names[doc], start, n, zlib.crc32(own[start : start + n]), len(own), base + sequences + i, offset, padded, base + int(group[i])))
                    offset += n
            sequences += len(windows)
            groups += int(group.max()) + 1 - groups if len(group) else 0
            whole, left = [], {doc for pieces in pool.by_length.values() for doc, _ in pieces}
            ids = {doc: ids[doc] for doc in left}
            held = 0
            columns = list(zip(*rows, strict=True)) or [()] * (len(COLUMNS) + 1)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_col, *COLUMNS])

        for batch, texts in byte_chunks(batches, text_col):
            id_type = batch.column(id_col).type
            for name, text in zip(batch.column(id_col).to_pylist(), texts, strict=True):
                doc = len(names)
                names.append(name)
                ids[doc] = own = np.append(encode(text.decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
                cut = len(own) // longest * longest
                whole.extend([(doc, at, longest)] for at in range(0, cut, longest))
                if cut < len(own):
                    pool.put(len(own) - cut, doc, cut)
                held += len(own)
                if held >= ROUND_TOKENS:
                    yield flush(False)
        if names:
            yield flush(True)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
