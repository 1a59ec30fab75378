"""Toxicity: class-conditional Kneser-Ney models.

A class gives a word its Kneser-Ney continuation probability: the number of different words that come before it in the
class's texts, less a discount. What the discounts leave goes to backoff counts that the classes share: in how many
classes a word was seen at all. So a rare expression speaks for neither class, and one that a class uses in many
places speaks for that class. The toxic and the ordinary log-likelihood are compared a word, over the whole text and
in windows of a few words that run over all of it; a logistic calibration turns this into a score.

Bigrams and continuation counts are exact, by 64-bit word hashes; the model that tasks hold has one number for each of
2**BITS word bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import fit_logistic, logistic
from .common import byte_chunks
from .wordhash import hash_words

#: Bins of the model; the discount; words in a window; a window's ratio a word that counts as strong; labelled rows
#: that the calibration takes at most.
BITS, DISCOUNT, WINDOW, STRONG, CALIBRATION_ROWS = 20, 0.75, 2, 1.0, 20_000
EDGE = np.uint64(1)
_HALF = np.uint64(32)
MEASURES = ("whole", "peak", "size", "strong_share", "strong_sum")


def word_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams as two 32-bit word numbers in a uint64, words of each text); a text's first word follows EDGE."""
    hashes, words = hash_words(texts)
    now = hashes >> _HALF
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(np.cumsum(words) - words)[words > 0]] = EDGE
    return (before << _HALF) | now, words


def bigrams(docs: DataFrame, *, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(pair, k0, k1) over all rows: whether each bigram stands in a text of label 0 and of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            pairs, words = word_pairs(texts)
            label = np.repeat(batch.column(label_col).to_numpy(zero_copy_only=False).astype(np.int64), words)
            found, code = np.unique(pairs, return_inverse=True)
            seen = (np.bincount(2 * code + label, minlength=2 * len(found)) > 0).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(seen[:, 0].astype(np.int8)), pa.array(seen[:, 1].astype(np.int8))], ["pair", "k0", "k1"])

    seen = docs.select(text_col, F.col(label_col).cast("int").alias(label_col)).mapInArrow(run, "pair long, k0 byte, k1 byte")
    return seen.groupBy("pair").agg(F.max("k0").alias("k0"), F.max("k1").alias("k1"))


def log_ratios(continuation: np.ndarray) -> np.ndarray:
    """For each bin log P(word | toxic) - log P(word | ordinary), from continuation counts (classes x bins)."""
    classes = (continuation > 0).sum(0)
    shared = np.maximum(classes, 0.5)
    shared = shared / shared.sum()
    log = []
    for own in continuation.astype(np.float64):
        total = max(own.sum(), 1.0)
        cut = np.maximum(own - DISCOUNT, 0)
        log.append(np.log(cut / total + max(total - cut.sum(), DISCOUNT) / total * shared))
    return (log[1] - log[0]).astype(np.float32)


@dataclass
class ToxicityModel:
    ratio: np.ndarray
    weights: np.ndarray

    def measures(self, texts: list[bytes]) -> np.ndarray:
        """The columns MEASURES for each text; without words all are 0."""
        hashes, words = hash_words(texts)
        x = np.zeros((len(texts), len(MEASURES)))
        has = np.flatnonzero(words)
        if len(has):
            ratio = self.ratio[(hashes >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.float64)
            n = words[has]
            first = np.cumsum(n) - n
            upto = np.concatenate([[0], np.cumsum(ratio)])
            end = np.arange(1, len(ratio) + 1)
            window = (upto[end] - upto[np.maximum(end - WINDOW, np.repeat(first, n))]) / WINDOW
            strong = np.add.reduceat(np.maximum(window - STRONG, 0), first)
            x[has] = np.column_stack([np.add.reduceat(ratio, first) / n, np.maximum.reduceat(window, first), np.log(n), np.sqrt(strong / n), np.log1p(strong)])
        return x

    def score(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.measures(texts) @ self.weights[:-1] + self.weights[-1])


def fit_toxicity(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> ToxicityModel:
    """From rows (id, text, label 0/1). A fifth of the rows, by their hashed ids, calibrates, but no more than about
    CALIBRATION_ROWS; the counts cover all others. Null labels are left out, null texts are empty. With no rows every
    score is 0.5."""
    labelled = labelled.filter(F.col(label_col).isin(0, 1)).select(id_col, text_col, F.col(label_col).cast("int").alias(label_col))
    rows = labelled.count()
    calibrates = F.pmod(F.xxhash64(F.col(id_col).cast("string")), 1_000_000) < int(1_000_000 * min(0.2, CALIBRATION_ROWS / max(rows, 1)))
    pairs = bigrams(labelled.filter(~calibrates), text_col=text_col, label_col=label_col)
    # The high bits of a bigram's second word are its bin.
    binned = pairs.groupBy(F.shiftright(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 32 - BITS).cast("int").alias("bin"))
    rows = binned.agg(F.sum("k0").alias("n0"), F.sum("k1").alias("n1")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[:, rows["bin"].to_numpy()] = rows["n0"].to_numpy(), rows["n1"].to_numpy()
    model = ToxicityModel(log_ratios(counts), np.zeros(len(MEASURES) + 1))
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            x = sent.value.measures(texts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(label_col), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], [id_col, "label", *MEASURES])

    schema = f"{id_col} {dict(labelled.dtypes)[id_col]}, label int, " + ", ".join(f"{m} double" for m in MEASURES)
    sample = labelled.filter(calibrates).mapInArrow(measure, schema).toArrow()
    model.weights = fit_logistic(np.column_stack([sample[m].to_numpy() for m in MEASURES]), sample["label"].to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id, ``keep`` columns and score (0 to 1). Null, empty and wordless texts get the score of no evidence.

    Repeated rows stay; an empty table gives an empty result; other columns are not read."""
    types = dict(docs.dtypes)
    names = [id_col, *(keep or [])]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sent.value.score(texts))], [*names, "score"])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", score double")
