"""The pipeline's near copies against brute force over exact shingle sets."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from noticeworks.llm import nearcopies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(ids, texts):
    """Pairs at 0.8 or more, with their similarity."""
    sets, where, out = [shingles(t) for t in texts], defaultdict(list), {}
    for k, s in enumerate(sets):
        both = Counter(m for x in s for m in where[x])
        out |= {(ids[m], ids[k]): n / (len(sets[m]) + len(s) - n) for m, n in both.items() if 5 * n >= 4 * (len(sets[m]) + len(s) - n)}
        for x in s:
            where[x].append(k)
    return out


def grouped(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    ids = [r.doc_id for r in rows]
    pairs = similar_pairs(ids, [r.text for r in rows])
    assert sum(s < 0.85 for s in pairs.values()) > 5
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == grouped(ids, pairs)


def test_edited_copies_go(spark):
    """One edit in 250 words to 5 in 250: similarity 0.98 to 0.82; of texts under 0.8 both stay."""
    rng, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(250)]
        copy = list(words)
        for k in range(i % 6 + 1 if i % 6 < 5 else 12):
            copy[10 + 20 * k] = f"x{rng.randrange(5000)}"
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(copy), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = grouped([r[0] for r in rows], similar_pairs([r[0] for r in rows], [r[1] for r in rows]))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())
    assert len(set(want.values())) == 70


def test_large_group_of_near_copies(spark):
    """Siblings of one text, of which many are under 0.8 to each other, are one group; null and wordless texts another."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = [*enumerate([" ".join(base), *texts]), (900, None), (901, " \n"), (902, "")]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == grouped([r[0] for r in rows], [*similar_pairs([r[0] for r in rows], [r[1] for r in rows]), (900, 901), (900, 902)])


def test_fingerprints_are_simhashes():
    """A bit is 1 if set in over half of the hashes; at a similarity of 0.8 about 15 % of the bits differ."""
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 64, 700, np.uint64)
    masks, factors = nearcopies._multipliers()
    words = nearcopies.mix((hashes[:, None] ^ masks) * factors)
    got = nearcopies.fingerprint(hashes).view(np.uint8)
    for place in range(0, nearcopies.BITS, 37):
        column = words.view(np.uint8)[:, place // 8] >> (7 - place % 8) & 1
        assert got[place // 8] >> (7 - place % 8) & 1 == (2 * int(column.sum()) > 700)
    a, b = (nearcopies.fingerprint(hashes[k : k + 630]) for k in (0, 70))
    assert 110 < np.bitwise_count(a ^ b).sum() < nearcopies.APART


def test_pairs_come_through_the_pivots(spark, monkeypatch):
    """Near copies are found where the pivot distances let a pair pass, and nowhere else."""
    words = [f"w{i}" for i in range(90)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(words).upper())], "doc_id long, text string")
    assert {r.component_id for r in nearcopies.near_copies(docs).collect()} == {1}
    monkeypatch.setattr(nearcopies, "near_pairs", lambda fp, a, b, distance, table: np.zeros(0, np.int64))
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_brief_texts_and_full_buckets(spark, monkeypatch):
    """Texts of few shingles, of which one word more changes a fifth, and groups larger than what meets in order."""
    rng, rows = random.Random(7), []
    for i in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    for g in range(2):
        base = [f"b{g}x{i}" for i in range(100)]
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(100), k % 4):
                words[at] = f"e{rng.randrange(10**6)}"
            rows.append((100 + 20 * g + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = grouped([r[0] for r in rows], similar_pairs([r[0] for r in rows], [r[1] for r in rows]))
    for window, block in ((2, 7), (128, 512)):
        monkeypatch.setattr(nearcopies, "WINDOW", window)
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want


def test_rows_written_follow_the_texts(spark, monkeypatch):
    """Four times the texts of a group that are near, most of them below 0.8 to each other, write at most eight times the rows,
    not sixteen; several chunks a group find the same links."""
    written = {}

    def counted(df, name, **options):
        out = store(df, name, **options)
        written[name] = written.get(name, 0) + out.df.count()
        return out

    store = nearcopies.store
    monkeypatch.setattr(nearcopies, "store", counted)
    rng, base, rows = random.Random(12), [f"w{i}" for i in range(150)], []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(150), 3 + i % 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sums = []
    for n in (60, 240):
        written.clear()
        got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(3)).collect()}
        pairs = similar_pairs([r[0] for r in rows[:n]], [r[1] for r in rows[:n]])
        assert got == grouped([r[0] for r in rows[:n]], pairs) and len(set(got.values())) > 5
        sums.append(sum(v for k, v in written.items() if k not in ("copies-marked", "copies-nodes")))
    assert sums[1] <= 8 * sums[0]
    monkeypatch.setattr(nearcopies, "BLOCK", 50)
    assert got == {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
