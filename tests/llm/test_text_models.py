"""Toxicity, language ID and quality: held-out accuracy and odd rows."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import langid, quality, queries, toxicity, wordhash
from noticeworks.llm.wordhash import hash_words

SOME = "/root/testdata/sf0.01"


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_word_hashes():
    texts = [b"", b"Ab ab\nAB, a-b", b"...", "é é".encode(), b"x" * 300_000 + b" ab"]
    h, n = hash_words(texts)
    assert n.tolist() == [0, 5, 0, 2, 2]
    assert h[0] == h[1] == h[2] == h[8] and h[3] != h[4] and h[5] == h[6]


def test_long_texts_are_gone_through_in_parts(spark, corpus, monkeypatch):
    """Words, trigrams and languages do not depend on where a text is cut; one word may be longer than a part."""
    texts = [t.encode() for t in corpus.text.dropna()] + [b"", b"x" * 5000 + b" a b", "é".encode() * 3000, b" \n", b"end"]
    model = langid.fit_languages(spark.createDataFrame(corpus[["text", "lang"]]))
    whole = [*hash_words(texts), *langid.trigrams(texts)]
    languages = langid.infer(model, texts[:60])
    for size in (100, 4097):
        monkeypatch.setattr(wordhash, "SEGMENT", size)
        monkeypatch.setattr(langid, "SEGMENT", size)
        for got, want in zip([*hash_words(texts), *langid.trigrams(texts)], whole, strict=True):
            assert np.array_equal(got, want)
        pred, score, sets = langid.infer(model, texts[:60])
        assert (pred, sets) == (languages[0], languages[2]) and np.allclose(score, languages[1])


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.85), ("op5_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.queries()[name](spark, SOME).toPandas().merge(pd.read_parquet(f"{SOME}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert auc(held.score, held[label].to_numpy()) >= least


def test_language_accuracy(spark):
    got = queries.op2_language_id(spark, SOME).toPandas().merge(pd.read_parquet(f"{SOME}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_mixture_is_seen(spark, corpus):
    docs = spark.createDataFrame(corpus[["text", "lang"]])
    model = langid.fit_languages(docs)
    en, de = (" ".join(corpus[corpus.lang == x].text.head(6)) for x in ("en", "de"))
    pred, score, sets = langid.infer(model, [f"{en} {de}".encode(), en.encode(), b"", "漢".encode(), "—".encode()])
    assert set(sets[0]) >= {"en", "de"} and score[0] < 0.9
    assert pred[1] == "en" and score[1] > 0.9 and pred[2] == "und" and pred[3] in model.languages and pred[4] == "und"


def test_mixtures_do_not_depend_on_what_is_kept(spark, corpus, monkeypatch):
    """Texts whose likelihoods are computed anew in each round get what they get from kept ones."""
    model = langid.fit_languages(spark.createDataFrame(corpus[["text", "lang"]]))
    by = {x: corpus[corpus.lang == x].text.tolist() for x in model.languages}
    texts = [" ".join(by[x][k] for x in model.languages[: 1 + k % 4]).encode() for k in range(12)]
    whole = langid.infer(model, texts)
    assert {len(x) for x in whole[2]} >= {1, 2, 3}
    for kept, segment in ((1, 512), (3000, 2048)):
        monkeypatch.setattr(langid, "KEPT", kept)
        monkeypatch.setattr(langid, "SEGMENT", segment)
        pred, score, sets = langid.infer(model, texts)
        assert (pred, sets) == (whole[0], whole[2]) and np.allclose(score, whole[1])


def test_memory_follows_parts_of_a_long_text():
    """A text of two languages among 40, of which the likelihoods of all words would take 200 MB at 8 bytes each."""
    import tracemalloc

    rng = np.random.default_rng(5)
    model = langid.LanguageModel([f"l{i:02}" for i in range(40)], np.log(rng.dirichlet(np.full(langid.BINS, 0.05), 40).T + 1e-7).astype(np.float32))
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(3000)]
    bins, first, _ = langid.trigrams([" ".join(words).encode()])
    best = np.concatenate([x for _, _, x in langid.word_likelihoods(model.logp, bins, np.append(first, len(bins)))]).argmax(1)
    mine = [w for w, b in zip(words, best, strict=True) if b in (3, 8)]
    text = " ".join(mine[i] for i in rng.integers(0, len(mine), 650_000)).encode()
    tracemalloc.start()
    pred, _, sets = langid.infer(model, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(sets[0]) == {"l03", "l08"} and pred[0] in sets[0] and peak < 120 << 20


def plain_mixture(model, text):
    """EM and the choice of the set for one text, word by word."""
    import math

    low = "".join(c.lower() if c.isascii() else c for c in text).encode()
    letters = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
    likes = []
    for w in letters.split():
        padded = b" " + w + b" "
        bins = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(w))]
        likes.append([sum(float(model.logp[b, k]) for b in bins) for k in range(len(model.languages))])
    n, langs = len(likes), range(len(model.languages))

    def em(share):
        rounds = 0
        while True:
            rounds += 1
            joint = [[share[k] * math.exp(max(w[k] - max(w), -80.0)) for k in langs] for w in likes]
            new = [sum(j[k] / sum(j) for j in joint) / n for k in langs]
            moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
            if rounds % langid.LOOK == 0 and moved <= langid.SETTLED:
                break
        return share, sum(max(w) + math.log(sum(share[k] * math.exp(max(w[k] - max(w), -80.0)) for k in langs)) for w in likes)

    cost = langid.PENALTY * math.log1p(n)
    single = [sum(w[k] for w in likes) for k in langs]
    best = max(langs, key=lambda k: single[k])
    gain, chosen, score = single[best], [best], 1 / sum(math.exp(max(s - single[best], -700)) for s in single)
    full, _ = em([1 / len(langs)] * len(langs))
    order = sorted(langs, key=lambda k: -full[k])
    for size in range(2, len(langs) + 1):
        share, ll = em([1 / size if k in order[:size] else 0.0 for k in langs])
        if ll - (size - 1) * cost > gain:
            gain, chosen = ll - (size - 1) * cost, sorted(langs, key=lambda k: -share[k])[:size]
            score = share[chosen[0]]
    return model.languages[chosen[0]], score, {model.languages[k] for k in chosen}


def test_mixtures_equal_plain_inference(spark, corpus):
    model = langid.fit_languages(spark.createDataFrame(corpus[["text", "lang"]]))
    by = {x: corpus[corpus.lang == x].text.str.slice(0, 700).tolist() for x in model.languages}
    texts = [t for x in model.languages for t in by[x][:4]]
    texts += [" ".join(by[x][k][: 200 + 90 * k] for x in model.languages[: 2 + k % (len(model.languages) - 1)]) for k in range(6)]
    pred, score, sets = langid.infer(model, [t.encode() for t in texts])
    for i, t in enumerate(texts):
        want = plain_mixture(model, t)
        assert (pred[i], set(sets[i])) == (want[0], want[2]) and abs(score[i] - want[1]) < 1e-6
    assert max(map(len, sets)) > 2


def test_ratios_equal_plain_kneser_ney():
    """Continuation counts less a discount, and a shared backoff by the classes that saw the word."""
    import math

    counts = np.array([[5, 1, 0, 0, 7], [2, 0, 3, 0, 1]])
    classes = [sum(c[w] > 0 for c in counts) or 0.5 for w in range(5)]
    want = []
    for w in range(5):
        log = []
        for own in counts:
            kept = max(own[w] - toxicity.DISCOUNT, 0) / own.sum()
            left = 1 - sum(max(x - toxicity.DISCOUNT, 0) for x in own) / own.sum()
            log.append(math.log(kept + left * classes[w] / sum(classes)))
        want.append(log[1] - log[0])
    assert np.allclose(toxicity.log_ratios(counts), want, atol=1e-6)


def test_counts_and_measures_equal_plain_ones(spark):
    rows = [(1, "a b a b c", 0), (2, "a b x", 1), (3, "b c b c", 0), (4, None, 1), (5, "x x x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {(r.k0, r.k1): 0 for r in toxicity.bigrams(df).collect()}
    seen = {}
    for _, t, y in rows:
        w = ["^", *(t or "").split()]
        for pair in zip(w, w[1:], strict=False):
            seen.setdefault(pair, set()).add(y)
    found = toxicity.bigrams(df).collect()
    assert sorted((r.k0, r.k1) for r in found) == sorted((int(0 in y), int(1 in y)) for y in seen.values()) and len(got) == 3
    rng = np.random.default_rng(2)
    model = toxicity.ToxicityModel(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), np.zeros(6))
    texts = [b"a b c d e f", b"", b"b", b"c c"]
    for t, m in zip(texts, model.measures(texts), strict=True):
        r = [float(model.ratio[int(h) >> (64 - toxicity.BITS)]) for h in hash_words([t])[0]]
        windows = [(r[i] + (r[i - 1] if i else 0.0)) / 2 for i in range(len(r))]
        strong = sum(max(x - toxicity.STRONG, 0) for x in windows)
        assert np.allclose(m, [sum(r) / len(r), max(windows), np.log(len(r)), (strong / len(r)) ** 0.5, np.log1p(strong)] if r else 0)


def test_discriminant_equals_plain_densities():
    """Means, shrunk covariances and Mahalanobis log-densities by their definitions; a class of too few rows takes the
    pooled covariance."""
    rng = np.random.default_rng(3)
    for n1 in (60, 3):
        x = [rng.normal(0, 1, (80, 4)), rng.normal(1, 2, (n1, 4))]
        model = quality.discriminant(np.array([80.0, n1]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
        cov = [np.cov(a.T, bias=True) for a in x]
        pooled = (80 * cov[0] + n1 * cov[1]) / (80 + n1)
        probe = rng.normal(0, 1, (5, 4))
        density = []
        for k in (0, 1):
            own = cov[k] if len(x[k]) > 4 else pooled
            s = (1 - quality.TO_SPHERE) * ((1 - quality.TO_POOLED) * own + quality.TO_POOLED * pooled) + quality.TO_SPHERE * np.diag(np.diag(pooled)) + 1e-9 * np.eye(4)
            d = probe - x[k].mean(0)
            density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
        assert np.allclose(model.difference(probe), (density[1] - density[0]) / 4)


def test_statistics_equal_plain_ones():
    import math

    texts = ["Hello, World!! 42\nHello\n\n", "", "héé --- ### a a a", "\n"]
    for t, row in zip(texts, quality.statistics([x.encode() for x in texts]), strict=True):
        raw = t.encode()
        words = [w.lower() for w in re.findall(rb"(?:[A-Za-z0-9]|[\x80-\xff])+", raw)]
        lines, n, w = raw.split(b"\n"), max(len(raw), 1), max(len(words), 1)
        count = lambda f: sum(map(f, raw))
        stop, letter, digit = (lambda b: b in b".,;:!?"), (lambda b: chr(b).isascii() and chr(b).isalpha()), (lambda b: 48 <= b <= 57)
        symbol = lambda b: 32 < b < 127 and not (letter(b) or digit(b) or stop(b))
        marks = count(stop) + count(symbol)
        doubled = sum(a == b and symbol(a) for a, b in zip(raw, raw[1:], strict=False))
        root = lambda a, b: math.sqrt(a / b)
        want = [
            math.log1p(len(raw)), math.log1p(len(words)), math.log1p((len(raw) - raw.count(b"\n")) / w), root(count(letter), n), root(count(digit), n), root(count(lambda b: letter(b) and b < 97), n), root(count(stop), n), root(count(symbol), n),
            root(count(lambda b: b > 127), n), root(raw.count(b"\n"), n), root(len(set(words)), w), root(max(map(words.count, words), default=0), w), root(len(set(lines)), len(lines)), math.log1p(len(raw) / len(lines)), math.log1p(marks / w), root(doubled, n),
        ]
        assert np.allclose(row, want, atol=1e-5), t


def test_odd_rows(spark, odd, none):
    labelled = odd.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label"))
    tox = toxicity.score_toxicity(odd, toxicity.fit_toxicity(labelled), keep=["fp"]).toPandas()
    assert len(tox) == odd.count() and tox.score.between(0, 1).all()
    lang = langid.predict_languages(odd, langid.fit_languages(odd)).toPandas()
    assert len(lang) == odd.count() and set(lang[lang.doc_id.isin([1, 2, 3, 4])].lang_pred) == {"und"}
    stats = quality.document_statistics(odd)
    scored = quality.score_quality(stats, quality.fit_quality(stats.join(labelled.select("doc_id", "label").distinct(), "doc_id")), keep=["doc_id"]).toPandas()
    assert len(scored) == odd.count() and np.isfinite(scored.score).all()


def test_empty_tables(spark, odd, none):
    no_labels = none.select("doc_id", "text", F.lit(1).alias("label"))
    assert set(toxicity.score_toxicity(odd, toxicity.fit_toxicity(no_labels)).toPandas().score) == {0.5}
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(no_labels)).count() == 0
    assert set(langid.predict_languages(odd, langid.fit_languages(none)).toPandas().lang_pred) == {"und"}
    stats = quality.document_statistics(none)
    model = quality.fit_quality(stats.withColumn("label", F.lit(1)))
    assert quality.score_quality(stats, model, keep=["doc_id"]).count() == 0
