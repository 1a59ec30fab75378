"""Filter audit, sharding and source divergence against plain versions."""

from __future__ import annotations

import binascii
import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import common, divergence, filteraudit, sharding

# ---- filter interaction audit


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_intervals_are_the_removal_steps(k):
    orders = list(itertools.permutations(range(k)))
    want = {(mask, rank): next((s for s, f in enumerate(order, 1) if mask >> f & 1), 0) for mask in range(1 << k) for rank, order in enumerate(orders)}
    got = dict.fromkeys(want, 0)
    for mask, step, low, high in filteraudit.removal_intervals(k):
        for rank in range(low, high):
            assert got[mask, rank] == 0
            got[mask, rank] = step
    assert got == want


def test_lehmer_rank():
    assert [filteraudit.lehmer_rank(p, 5) for p in itertools.permutations(range(5))] == list(range(120))


def brute_audit(rows, names):
    """rows: (part, set of failed filters, good)."""
    out = []
    for part in sorted({p for p, _, _ in rows}):
        mine = [(fails, good) for p, fails, good in rows if p == part]
        gone = Counter()
        for order in itertools.permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                gone[f] += len(lost)
                failing = sum(f in x[0] for x in mine)
                out.append([part, "".join(order), step, len(left), len(lost), failing - len(lost), sum(x[0] == {f} for x in mine), sum(x[1] for x in lost), f])
        for row in out:
            if row[0] == part:
                row[-1] = gone[row[-1]]
    return sorted(map(tuple, out))


def test_audit_of_orders(spark):
    rng = np.random.default_rng(3)
    rows = [(["p", "q", None][rng.integers(3)], *(bool(rng.random() < 0.4) if rng.random() < 0.9 else None for _ in range(3)), bool(rng.random() < 0.5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "mask string, n boolean, part boolean, rank boolean, total boolean")  # names that the operator uses itself
    got = filteraudit.audit_orders(df, {"X": F.col("n"), "Y": F.col("part"), "Z": F.col("rank")}, part=F.col("mask"), measures={"good": F.col("total")})
    plain = [(p or "", {f for f, v in zip("XYZ", flags, strict=True) if v}, bool(g)) for p, *flags, g in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(plain, "XYZ")


def test_filters_of_a_text():
    words = re.compile(r"[^\x20\x09-\x0D]+")
    long = " ".join(f"word{i % 9}" for i in range(400_000))  # of several pieces
    for text in ["", " ", "a", "A b", "a b " * 200, "Ünïcödé 漢字 " * 120, "ABC def", "x|y", "a b\x1cc", long, "x" * 3_000_000]:
        w = words.findall(text)
        want = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)))
        assert filteraudit.TextFilters().fails(text.encode()) == want


def test_audit_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    plain = []
    for i, text in docs:
        fails = {f for f, x in zip("ABCD", filteraudit.TextFilters().fails(text.encode()), strict=True) if x}
        if i is not None and any(j is not None and j < i and t == text for j, t in docs):
            fails.add("E")
        plain.append(("", fails, i == 5))
    got = filteraudit.audit_documents(odd, labels).collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in got) == brute_audit(plain, "ABCDE")
    assert sum(r.toxic_lost for r in got if r.filter_order == "ABCDE") == 1
    assert filteraudit.audit_documents(none, labels).count() == 0
    assert filteraudit.audit_documents(odd, labels.limit(0)).filter("good_lost > 0").count() == 0


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 64, 97, 1000, 9_999])
def test_permutation_and_inverse(spark, n):
    p = sharding.Feistel(n, seed=n)
    walk = p.walk_length(spark)
    rows = spark.range(n).select("id", p.place(F.col("id"), walk).alias("place")).withColumn("back", p.number(F.col("place"), walk)).collect()
    assert sorted(r.place for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_permutation_of_many_rows(spark):
    p = sharding.Feistel(10**12 + 39, seed=5)
    walk = 2
    rows = spark.range(10**12, 10**12 + 39).select("id", p.place(F.col("id"), walk).alias("place")).withColumn("back", p.number(F.col("place"), walk)).collect()
    assert all(0 <= r.place < p.n and r.back == r.id for r in rows) and len({r.place for r in rows}) == 39
    with pytest.raises(ValueError, match="number of rows"):
        sharding.Feistel(1 << 62)


def test_a_shuffle_mixes(spark):
    """Neighbours do not stay neighbours, every shard draws from all parts, and seeds differ."""
    n = 20_000
    places = {}
    for seed in (1, 2):
        p = sharding.Feistel(n, seed)
        places[seed] = np.array([r[0] for r in spark.range(n).coalesce(1).select(p.place(F.col("id"), p.walk_length(spark))).collect()])
    x = places[1]
    assert abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.05
    assert abs(np.corrcoef(x, places[2])[0, 1]) < 0.05
    table = np.zeros((16, 16))
    np.add.at(table, (np.arange(n) * 16 // n, x % 16), 1)
    expected = n / 256
    assert ((table - expected) ** 2 / expected).sum() < 225 + 6 * np.sqrt(450)


def test_row_numbers(spark):
    rows = [(i % 7 or None, "same") for i in range(200)] + [(3, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, _first string").repartition(5)  # a name that the operator uses itself
    got = sharding.number_rows(df.withColumnRenamed("_first", "v"), ["k", "v"]).collect()
    assert sorted(r.row_number for r in got) == list(range(250))
    key = lambda r: (r.k is not None, r.k or 0, r.v)
    assert [key(r) for r in sorted(got, key=lambda r: r.row_number)] == sorted(map(key, got))


def test_shards_of_odd_documents(spark, odd, none):
    got = sharding.shard_rows(odd, 4, seed=2).toPandas()
    texts = sorted((t or "").encode() for t in [r.text for r in odd.collect()])
    assert sorted(got["size"]) == sorted(len(t) + 1 for t in texts)
    assert sorted(got.text_crc32) == sorted(binascii.crc32(t) for t in texts)
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = sharding.shard_rows(odd.repartition(7), 4, seed=2).toPandas()
    order = ["doc_id", "size", "text_crc32", "shard", "slot"]
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), again[order].sort_values(order, ignore_index=True))
    assert sharding.shard_rows(none, 4).count() == 0
    assert sharding.shard_rows(odd, 1000).count() == len(got)


# ---- source divergence


def brute_divergence(rows, least=3, top=200):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for x, _, found in terms if x == lang for t in set(found))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter() for x, s, _ in terms if x == lang}
        for x, s, found in terms:
            if x == lang:
                counts[s].update(t for t in found if df[t] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            best = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 48, 1024), (7, 3, 5)])
def test_divergence(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "TERMS", blocks[0])
    monkeypatch.setattr(divergence, "SOURCES", blocks[1])
    rng = np.random.default_rng(9)
    vocabulary = [f"{c}{d}" for c in "abcdé漢" for d in "vwxyz"]
    rows = [(["en", "de", None][i % 3], f"s{rng.integers(8)}", " ".join(vocabulary[int(30 * rng.random() ** 3)].upper() if rng.random() < 0.2 else vocabulary[int(30 * rng.random() ** 3)] for _ in range(40))) for i in range(120)]
    rows += [("fr", "s1", "nothing here is kept"), ("fr", None, "by anyone"), ("es", "s1", None), (None, None, ""), ("en", "quiet", "12 3"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").select("*", F.lit(1).alias("term"), F.lit(2).alias("total"), F.lit(3).alias("n")).repartition(4)
    got = divergence.audit_sources(df, top_terms=6)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, top=6)


def test_divergence_of_odd_documents(odd, none):
    want = brute_divergence([(r.lang, r.source, r.text) for r in odd.collect()], least=1)
    assert sorted(tuple(r) for r in divergence.audit_sources(odd, least_docs=1).collect()) == want
    assert divergence.audit_sources(none).count() == 0


def test_joint_tables(monkeypatch):
    monkeypatch.setattr(divergence, "COLUMNS", 3)  # so that products go block by block
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 4, (50, 3)), rng.integers(0, 3, (50, 2))
    got = Counter()
    for g, c, h, d, n in divergence.joint_tables(left, right):
        for key in zip(g, c, h, d, strict=True):
            assert key not in got
        got.update({tuple(map(int, key)): int(x) for *key, x in zip(g, c, h, d, n, strict=True)})
    want = Counter((g, int(row[g]), h, int(other[h])) for row, other in zip(left, right, strict=True) for g in range(3) for h in range(2))
    assert got == want


def test_shares_beyond_64_bits(spark):
    counts, totals = np.array([0, 1, 10**12, 4 * 10**15]), np.array([1, 3, 3 * 10**12 + 1, 4 * 10**15 + 1])
    want = [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals, strict=True)]
    assert divergence._share(counts, totals).tolist() == want
    df = spark.createDataFrame([(int(c), int(t)) for c, t in zip(counts, totals, strict=True)], "c long, t long").coalesce(1)
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("t"))).collect()] == want


def test_pieces_cut_no_word():
    text = ("wörd " * 300_000 + "x" * 2_500_000 + " end").encode()
    found = list(common.pieces(text, filteraudit.WORD))
    assert b"".join(found) == text and len(found) > 1
    assert [w for p in found for w in p.split()] == text.split()
