"""Language identification by mixture inference.

Each word is drawn from one of the document's languages; a language gives a word the product of its hashed byte
trigrams' probabilities. Expectation-maximisation estimates the proportions of the languages, and the set of
languages is chosen by penalised likelihood.

Word likelihoods are taken a part of the words at a time. Texts whose likelihoods fit KEPT are grouped and keep them for
all rounds of EM; those of a longer text are computed anew in each round, so memory follows neither its length times the
number of languages nor the number of rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, runs
from .wordhash import SEGMENT, segments

BINS, SMOOTHING, PENALTY = 1 << 16, 0.1, 4.0
#: EM ends for a document when no share moves by more than this in a round; rounds between two looks.
SETTLED, LOOK = 1e-3, 4
#: Word likelihoods (words x languages) that EM keeps; trigram likelihoods that are taken at a time, for each byte of a part.
KEPT, WIDE = 1 << 20, 4
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Bytes as the model sees them: a-z, bytes beyond ASCII, and 32 for all others."""
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return np.where(((lower >= 97) & (lower <= 122)) | (byte >= 128), lower, 32).astype(np.uint8)


_LETTERS = _letters()
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _part(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bins, words' starts among them, words' starts in the buffer) of a part that ends with 32."""
    inside = buf != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    wide = np.concatenate(([32], buf)).astype(np.uint32)
    at = np.flatnonzero(inside) + 1  # a trigram is centred on each byte of a word
    code = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
    size = end - start
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16), np.cumsum(size) - size, start


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bins, start of each word among them, words of each text); a word of n bytes has n trigrams."""
    buf = _LETTERS[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    if not len(buf):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    bins, first, start, before = [], [], [], 0
    for a, b in segments(buf == 32, SEGMENT):
        own, at, where = _part(buf[a:b])
        bins.append(own)
        first.append(at + before)
        start.append(where + a)
        before += len(own)
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.concatenate(bins), np.concatenate(first), np.diff(np.searchsorted(np.concatenate(start), last), prepend=0)


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``most`` trigrams; a longer word stands alone."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def word_likelihoods(logp: np.ndarray, bins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, log-likelihoods by language of the words a to b), a part at a time. Word w has the trigrams from ends[w]
    to ends[w + 1]."""
    most = max(1, SEGMENT * WIDE // logp.shape[1])
    for a, b in _cuts(ends, most):
        if ends[b] - ends[a] > most:  # one long word
            whole = sum(logp[bins[at : min(at + most, ends[b])]].sum(0, dtype=np.float64) for at in range(ends[a], ends[b], most))
            yield a, b, whole[None, :]
        else:
            yield a, b, np.add.reduceat(logp[bins[ends[a] : ends[b]]], ends[a:b] - ends[a], axis=0).astype(np.float64)


@dataclass
class LanguageModel:
    """Languages in order of name, with log-probabilities of the trigram bins (bins x languages)."""

    languages: list[str]
    logp: np.ndarray


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram counts of every row with a language and a text. The model has BINS numbers for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch, texts in byte_chunks(batches, text_col):
            bins, first, words = trigrams(texts)
            upto = np.concatenate([first, [len(bins)]])[np.concatenate([[0], np.cumsum(words)])]
            names, codes = np.unique(np.array(batch.column(lang_col).to_pylist(), object).astype(str), return_inverse=True)
            for a in range(0, len(bins), SEGMENT):
                place = np.repeat(codes, np.diff(np.clip(upto, a, a + SEGMENT))) * BINS + bins[a : a + SEGMENT]
                flat = np.bincount(place, minlength=len(names) * BINS).reshape(len(names), BINS)
                for name, row in zip(names.tolist(), flat, strict=True):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "bin", "n"])

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    rows = known.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((BINS, len(languages)))
    counts[rows["bin"].to_numpy(), np.array([place[x] for x in names], np.int64)] = rows["n"].to_numpy()
    counts += SMOOTHING
    return LanguageModel(list(languages), np.log(counts / counts.sum(0)).astype(np.float32))


def _relative(like: np.ndarray) -> np.ndarray:
    """Likelihoods relative to the word's best language."""
    return np.exp(np.maximum(like - like.max(1, keepdims=True), -80.0))


class _Kept:
    """Relative likelihoods of the words of some texts, held in memory."""

    def __init__(self, like: np.ndarray, text: np.ndarray):
        self.like, self.text, self.first = like, text, np.flatnonzero(np.diff(text, prepend=-1))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(likelihoods, text of each word, where texts begin)."""
        yield self.like, self.text, self.first

    def only(self, stay: np.ndarray) -> _Kept:
        """Of the texts that stay, numbered anew."""
        rows = stay[self.text]
        return _Kept(self.like[rows], (np.cumsum(stay) - 1)[self.text[rows]])


class _Anew:
    """Relative likelihoods of the words of one long text, computed a part at a time whenever they are gone through."""

    def __init__(self, logp: np.ndarray, bins: np.ndarray, ends: np.ndarray):
        self.logp, self.bins, self.ends = logp, bins, ends

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b, like in word_likelihoods(self.logp, self.bins, self.ends):
            yield _relative(like), np.zeros(b - a, np.int64), np.zeros(1, np.int64)

    def only(self, stay: np.ndarray) -> _Anew:
        return self


def _em(likes: _Kept | _Anew, words: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions after EM, their log-likelihood, and a bound on what any proportions of all languages can reach.

    Texts whose proportions have settled are left out of the further rounds. The bound follows from concavity: other
    proportions gain no more than the words' number times the log of the greatest mean ratio of a language's likelihood
    to the mixture's."""
    done, open_texts = share.copy(), np.arange(len(words))
    own, n, now = likes, words, share
    while len(open_texts):
        for _ in range(LOOK):
            last, now = now, np.zeros_like(now)
            for like, text, first in own:
                joint = like * last[text]
                joint /= joint.sum(1, keepdims=True)
                now[text[first]] += np.add.reduceat(joint, first, axis=0)
            now /= n[:, None]
        done[open_texts] = now
        go = np.abs(now - last).max(1) > SETTLED
        own, open_texts, n, now = own if go.all() else own.only(go), open_texts[go], n[go], now[go]
    found, ratio = np.zeros(len(words)), np.zeros_like(share)
    for like, text, first in likes:
        mixed = (like * done[text]).sum(1)
        found[text[first]] += np.add.reduceat(np.log(mixed), first)
        ratio[text[first]] += np.add.reduceat(like / mixed[:, None], first, axis=0)
    return done, found, found + words * np.log(ratio.max(1) / words)


def _sets(likes: _Kept | _Anew, words: np.ndarray, base: np.ndarray, alone: np.ndarray, cost: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, languages by falling share, their shares) for every set that beats the best one so far, by growing size.
    A text is left out of the sizes that it cannot gain from any more."""
    n_lang = likes.logp.shape[1] if isinstance(likes, _Anew) else likes.like.shape[1]
    full, _, most = _em(likes, words, np.full((len(words), n_lang), 1.0 / n_lang))
    order = np.argsort(-full, axis=1, kind="stable")
    gain, open_texts = alone.copy(), np.arange(len(words))
    for k in range(2, n_lang + 1):
        stay = (most + base - (k - 1) * cost > gain)[open_texts]
        if not stay.all():
            likes, open_texts = likes.only(stay), open_texts[stay]
        if not len(open_texts):
            return
        allowed = np.zeros((len(open_texts), n_lang))
        np.put_along_axis(allowed, order[open_texts, :k], 1.0 / k, axis=1)
        share, ll, _ = _em(likes, words[open_texts], allowed)
        value = ll + (base - (k - 1) * cost)[open_texts]
        for j in np.flatnonzero(value > gain[open_texts]):
            gain[open_texts[j]] = value[j]
            by = np.argsort(-share[j], kind="stable")[:k]
            yield int(open_texts[j]), by, share[j, by]


def infer(model: LanguageModel, texts: list[bytes]) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """(main language, its score, chosen set by falling share) of each text."""
    n_lang = len(model.languages)
    pred, score, chosen = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    if not n_lang:
        return pred, score, chosen
    bins, first, words = trigrams(texts)
    # Bytes beyond ASCII need not be letters.
    blank = np.array([not _ASCII_LETTER.search(t) and not any(c.isalpha() for c in t.decode("utf-8", "replace")) for t in texts], bool)
    if blank.any():
        stay = np.repeat(~blank, words)
        size = np.diff(np.append(first, len(bins)))
        bins = bins[np.repeat(stay, size)]
        first = np.cumsum(size[stay]) - size[stay]
        words = np.where(blank, 0, words)
    has = np.flatnonzero(words)
    if not len(has):
        return pred, score, chosen
    ends = np.append(first, len(bins))
    count = words[has]
    upto = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(has), dtype=np.int32), count)
    single, bound = np.zeros((len(has), n_lang)), np.zeros(len(has))
    for a, b, like in word_likelihoods(model.logp, bins, ends):
        at = np.flatnonzero(np.diff(text[a:b], prepend=-1))
        single[text[a:b][at]] += np.add.reduceat(like, at, axis=0)
        bound[text[a:b][at]] += np.add.reduceat(like.max(1), at)
    best = single.argmax(1)
    top = single[np.arange(len(has)), best]
    cost = PENALTY * np.log1p(count)
    sure = np.exp(top - np.logaddexp.reduce(single, axis=1))
    sets = [[int(b)] for b in best]
    # No mixture can gain more than the bound: most documents need no EM.
    mixed = np.flatnonzero(bound - top > cost)
    for a, b in runs(count[mixed] * n_lang, KEPT):
        own = mixed[a:b]
        if len(own) == 1 and count[own[0]] * n_lang > KEPT:
            here = ends[upto[own[0]] : upto[own[0] + 1] + 1]
            likes = _Anew(model.logp, bins[here[0] : here[-1]], here - here[0])
        else:
            like = [x for d in own for _, _, x in word_likelihoods(model.logp, bins, ends[upto[d] : upto[d + 1] + 1])]
            likes = _Kept(_relative(np.concatenate(like)), np.repeat(np.arange(len(own)), count[own]))
        for j, by, share in _sets(likes, count[own], bound[own], top[own], cost[own]):
            sets[own[j]], best[own[j]], sure[own[j]] = by.tolist(), by[0], share[0]
    for i, d in enumerate(has):
        pred[d], score[d], chosen[d] = model.languages[best[i]], min(1.0, float(sure[i])), [model.languages[x] for x in sets[i]]
    return pred, score, chosen


def predict_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id, ``keep`` columns, lang_pred, score (share of that language, or its posterior if alone), lang_set.

    Null texts and texts without a letter are ``und`` with score 0 and an empty set, and so is every text if the
    model knows no language. Repeated rows stay; other columns are not read.
    """
    types = dict(docs.dtypes)
    names = [id_col, *(keep or [])]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", lang_pred string, score double, lang_set array<string>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            pred, score, chosen = infer(shared.value, texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(chosen, pa.list_(pa.string()))], [*names, "lang_pred", "score", "lang_set"])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, schema)
