"""Repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from noticeworks.llm import queries, suffixdedup

from ..conftest import SMALL


def brute(rows, length=100):
    """(n_bytes, n_removed, n_spans, sha) of each (id, text), in order of ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(raw)) if covered[k] and not (k and covered[k - 1]))
        out[i] = (len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered, strict=True) if not c)).hexdigest())
    return out


def report(df, **options):
    marked = suffixdedup.removal_report(df, **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in marked}


def test_query_equals_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SMALL).collect()}
    assert got == brute(list(zip(corpus.doc_id, corpus.text, strict=True)))


@pytest.fixture(scope="module")
def tangled():
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcde é") for _ in range(n)) for n in (99, 100, 101, 150, 320, 700)]
    rows = []
    for i in range(90):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 260)))]) for _ in range(rng.randrange(0, 6))]
        rows.append((i, "".join(parts)[rng.randrange(0, 40) :]))
    return rows + [(200, "a" * 1500), (201, "ab" * 900), (202, rows[3][1]), (203, "x" + rows[3][1]), (204, None), (205, "")]


@pytest.mark.parametrize("length", [82, 100, 130])
def test_tangled_texts(spark, tangled, length):
    df = spark.createDataFrame(tangled, "doc_id long, text string").repartition(5)
    assert report(df, length=length) == brute(tangled, length)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_strings_that_many_texts_share(spark, parts):
    """One string in 700 different contexts, over few and many partitions, with repeated rows and ids."""
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefghijklm ") for _ in range(n))
    hot, ends = draw(112), [draw(150) for _ in range(4)]
    rows = [(i, draw(90) + hot + draw(90) if i % 7 else draw(90) + hot + ends[i % 4][: 100 + i % 50]) for i in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows + rows[:40], "doc_id long, text string").repartition(7)
        assert report(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    rows = [(1, body), (2, body[1234:5678] + "!" + body[4000:])]
    want = brute(rows)
    from noticeworks.llm.suffixdedup import contexts_of

    whole = contexts_of([t.encode() for _, t in rows])
    monkeypatch.setattr(suffixdedup, "SEGMENT", 1000)
    cut = contexts_of([t.encode() for _, t in rows])
    assert sum(whole["n"]) == sum(cut["n"])
    assert report(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_odd_rows(spark, odd, none):
    got = report(odd)
    assert got[1][:3] == (0, 0, 0) and got[9][1] == got[9][0] and got[9][2] == 1
    assert suffixdedup.removal_report(odd).count() == odd.count() and suffixdedup.removal_report(none).count() == 0
    texts = {r.doc_id: r.text for r in suffixdedup.remove_repeats(odd).collect()}
    assert texts[9] == "" and texts[1] is None and suffixdedup.remove_repeats(odd).columns == odd.columns


def test_cut_characters_stay_whole(spark):
    shared = "é" * 60
    rows = [(1, "A" + shared), (2, "B" + shared), (3, "Ã" + shared)]
    got = {r.doc_id: r.text for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] in ("B", "Bé") and "\ufffd" not in "".join(got.values())
