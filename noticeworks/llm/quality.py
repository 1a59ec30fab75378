"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

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

FEATURES = ("bytes", "words", "word_bytes", "letters", "digits", "upper", "stops", "symbols", "beyond_ascii", "breaks", "distinct_words", "commonest_word", "distinct_lines", "line_bytes", "marks_a_word", "doubled_marks")
#: Shrinkage to the pooled covariance and to its mean variance; labelled rows that the calibration takes at most.
TO_POOLED, TO_SPHERE, CALIBRATION_ROWS = 0.1, 0.02, 20_000


def _kinds() -> np.ndarray:
    """For each byte: letter, digit, upper, stop (.,;:!?), symbol, beyond ASCII, line break."""
    byte = np.arange(256)
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)
    digit = (byte >= 48) & (byte <= 57)
    stop = np.isin(byte, list(b".,;:!?"))
    visible = (byte > 32) & (byte < 127)
    return np.stack([letter, digit, letter & (byte < 97), stop, visible & ~letter & ~digit & ~stop, byte >= 128, byte == 10], axis=1).astype(np.float32)


_KINDS = _kinds()


def statistics(texts: list[bytes]) -> np.ndarray:
    """Transformed statistics, a row for each text: logarithms of sizes and square roots of shares."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.cumsum(size + 1) - size - 1
    hist = np.array([np.bincount(buf[a : a + n], minlength=256) for a, n in zip(at.tolist(), size.tolist(), strict=True)], np.float32).reshape(-1, 256)
    letters, digits, upper, stops, symbols, beyond, breaks = (hist @ _KINDS).T
    hashes, words = hash_words(texts)
    doc = np.repeat(np.arange(len(texts)), words)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=len(texts))
    commonest = np.zeros(len(texts))
    np.maximum.at(commonest, d[new], np.diff(np.append(np.flatnonzero(new), len(h))))
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    distinct_lines = np.array([len(set(x)) for x in lines])
    doubled = np.zeros(len(texts))
    if len(buf):
        mark = _KINDS[:, 4].astype(bool)[buf]
        twice = np.flatnonzero(mark[1:] & (buf[1:] == buf[:-1]))
        doubled = np.bincount(np.searchsorted(at, twice, side="right") - 1, minlength=len(texts))
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda x, of: np.sqrt(x / of)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), np.log1p((size - breaks) / w), share(letters, n), share(digits, n), share(upper, n), share(stops, n), share(symbols, n), share(beyond, n), share(breaks, n),
            share(distinct, w), share(commonest, w), share(distinct_lines, n_lines), np.log1p(size / n_lines), np.log1p((stops + symbols) / w), share(doubled, n),
        ]
    ).astype(np.float64)


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>); null texts count as empty. Repeated rows stay; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            stats = statistics(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1]), pa.array(stats.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), flat], [id_col, "stats"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, stats array<double>")


@dataclass
class Discriminant:
    """Two Gaussians by mean and inverse Cholesky factor, and the calibration of their difference."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    weights: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density under class 1 less that under class 0, a feature."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            density.append(-0.5 * (z * z).sum(1) - self.log_det[k])
        return (density[1] - density[0]) / x.shape[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.difference(x)
        return logistic(np.column_stack([d, np.tanh(d)]) @ self.weights[:-1] + self.weights[-1])


def discriminant(n: np.ndarray, total: np.ndarray, square: np.ndarray) -> Discriminant:
    """From each class's number of rows, sums and sums of outer products."""
    size = total.shape[1]
    seen = np.maximum(n, 1)
    all_mean = total.sum(0) / max(1, n.sum())
    means = np.where((n > 0)[:, None], total / seen[:, None], all_mean)
    cov = square / seen[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / max(1, n.sum()) if n.sum() else np.eye(size)
    diagonal = np.maximum(np.diag(pooled), 1e-6)
    whiten, log_det = [], []
    for k in (0, 1):
        own = cov[k] if n[k] > size else pooled
        shrunk = (1 - TO_SPHERE) * ((1 - TO_POOLED) * own + TO_POOLED * pooled) + TO_SPHERE * np.diag(diagonal)
        chol = np.linalg.cholesky(shrunk + 1e-9 * np.eye(size))
        whiten.append(np.linalg.solve(chol, np.eye(size)))
        log_det.append(np.log(np.diag(chol)).sum())
    return Discriminant(means, np.array(whiten), np.array(log_det), np.zeros(3))


def fit_quality(labelled: DataFrame) -> Discriminant:
    """From rows (id, stats, label 0/1). Class sums cover all rows; the calibration takes the CALIBRATION_ROWS rows
    with the least hash of the id. Rows with a null label are left out; a class without rows has the overall mean."""
    size = len(FEATURES)
    labelled = labelled.filter("label in (0, 1)")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, size)
            y = batch.column("label").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                total[k] += own.sum(0)
                square[k] += own.T @ own
        flat = np.concatenate([n, total.reshape(-1), square.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

    rows = labelled.select("stats", F.col("label").cast("int").alias("label")).mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(2 + 2 * size + 2 * size * size)
    flat[rows["i"].to_numpy()] = rows["x"].to_numpy()
    model = discriminant(flat[:2], flat[2 : 2 + 2 * size].reshape(2, size), flat[2 + 2 * size :].reshape(2, size, size))
    id_col = next(c for c in labelled.columns if c not in ("stats", "label"))
    sample = labelled.orderBy(F.xxhash64(id_col), id_col).limit(CALIBRATION_ROWS).select("stats", "label").toArrow()
    if len(sample):
        d = model.difference(np.array(sample["stats"].to_pylist()))
        model.weights = fit_logistic(np.column_stack([d, np.tanh(d)]), sample["label"].to_numpy().astype(float))
    return model


def score_quality(stats: DataFrame, model: Discriminant, *, keep: list[str]) -> DataFrame:
    """``keep`` columns and score (0 to 1, the probability of label 1) of each row with ``stats``. A model without rows
    gives 0.5 to all; repeated rows stay; an empty table gives an empty result."""
    types = dict(stats.dtypes)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(x))], [*keep, "score"])

    return stats.select(*keep, "stats").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double")
