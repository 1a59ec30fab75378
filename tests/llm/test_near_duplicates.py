"""SimHash fingerprints and components, and decontamination, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from noticeworks.llm import decontam, queries, simhash

from ..conftest import SMALL


def fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, distance=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for m in range(k):
            if (fps[k] ^ fps[m]).bit_count() <= distance:
                x, y = find(a), find(ids[m])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, corpus):
    got = queries.op3_simhash(spark, SMALL).toPandas().set_index("doc_id")
    ids, fps = corpus.doc_id.tolist(), [fingerprint(t) for t in corpus.text]
    assert got.fingerprint.to_dict() == {i: f"{f:016x}" for i, f in zip(ids, fps, strict=True)}
    assert got.component_id.to_dict() == components(ids, fps)


def test_dense_clusters_and_chains(spark):
    rng = random.Random(11)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(60)]
    walk = rng.getrandbits(64)
    for _ in range(60):  # a long chain of links
        walk ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.append(walk)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.fp: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(7)).collect()}
    want = components(list(range(len(fps))), fps)
    seen = {}
    for i, f in enumerate(signed):
        seen.setdefault(want[i], set()).add(roots.get(f, f))
    assert all(len(r) == 1 for r in seen.values()) and len({next(iter(r)) for r in seen.values()}) == len(seen)


def test_pivots_lose_no_pair():
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), k % 7)) for k, f in enumerate(fps)]
    a, b = np.array([(i, j) for i in range(80) for j in range(i)]).T
    for distance in (0, 2, 4):
        got = simhash.near_pairs(np.array(fps, np.uint64), a, b, distance)
        assert got.tolist() == [k for k, (i, j) in enumerate(zip(a, b, strict=True)) if (fps[i] ^ fps[j]).bit_count() <= distance]


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    by = got.set_index("doc_id").component_id
    assert set(by.loc[[1, 2, 3]]) == {1} and by.loc[7] == 6 and by.loc[9] == 8 and set(by.loc[[5]]) == {5}
    assert set(got[got.doc_id.isin([1, 2, 3])].fingerprint) == {"0" * 16}
    assert simhash.near_duplicates(none).count() == 0


def words(text):
    return re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", (text or "").encode().lower())


def shares(part, text):
    own, other = words(part.decode()), words(text)
    if not own:
        return 1.0
    n = min(5, len(own))
    a = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
    b = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)}
    return len(a & b) / len(a)


def test_leaks_equal_brute_force(spark, corpus):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, SMALL).collect()}
    parts = {i: decontam.question_answer(t.encode()) for i, t in zip(items.item_id, items.text, strict=True)}
    want = {(d, i) for d, t in zip(corpus.doc_id, corpus.text, strict=True) for i, p in parts.items() if min(shares(x, t) for x in p) >= decontam.OVERLAP}
    assert got == want and want


def test_leak_cases(spark, odd, none):
    question = "what colour is the large old house beside the river mill on the hill. It is painted in a deep dark red every spring."
    items = spark.createDataFrame([(0, question, 1), (1, None, 1), (2, "", 1), (3, "", 1), (0, question, 1)], "item_id long, text string, doc_id int")
    filler = " ".join(f"f{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, f"{filler} {question.upper()} {filler}"), (2, question.split(".")[0]), (3, None), (4, filler), (5, f"{question} {question}"), (5, f"{question} {question}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).distinct().collect())
    assert got == [(1, 0), (5, 0)]
    assert decontam.find_leaks(odd, items).count() == 0 and decontam.find_leaks(none, items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0


def test_several_shards(spark, corpus, monkeypatch):
    """What is found, with its overlaps, does not depend on the number of shards or on how many texts meet one at a time;
    ids keep their type, repeated items stay, and the texts are read once."""
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").selectExpr("cast(item_id as int) as item_id", "text")
    docs = spark.createDataFrame(corpus)
    whole = sorted(tuple(r) for r in decontam.find_leaks(docs, items).collect())
    for size, held in ((700, 1), (3000, 100_000)):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        assert len(decontam.store_indexes(items, 3, item_id="item_id", item_text="text")) == 3
        found = decontam.find_leaks(docs, items.union(items), held_bytes=held)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Union" not in plan and dict(found.dtypes)["item_id"] == "int"
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted(2 * [r[:2] for r in whole])


def test_retrieval_equals_plain_bm25(corpus):
    """Every item that scores the threshold or more in a passage is retrieved, and no other."""
    import math
    from collections import Counter

    import numpy as np

    from noticeworks.llm.wordhash import hash_words

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choices(vocabulary, weights=range(1, 61), k=n))
    items = [draw(rng.randrange(5, 40)) for _ in range(50)]
    texts = [" ".join([draw(rng.randrange(0, 90)), " ".join(rng.sample(items[k % 50].split(), 5 + k % 30 if k % 30 + 5 < len(items[k % 50].split()) else 5)), draw(20)]) for k in range(60)]
    own = [i.split() for i in items]
    n, mean, df = len(items), sum(map(len, own)) / len(own), Counter(w for o in own for w in set(o))

    def weights(o):
        tf = Counter(o)
        w = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (decontam.K1 + 1) / (c + decontam.K1 * (1 - decontam.B + decontam.B * len(o) / mean)) for t, c in tf.items()}
        return {t: x / sum(w.values()) for t, x in w.items()}

    hashed = {w: hash_words([w.encode()])[0][0] for w in vocabulary}
    terms = np.sort(np.array([hashed[w] for w in df], np.uint64))
    known = decontam.ItemStatistics(n, mean, terms, np.array([df[next(w for w in df if hashed[w] == t)] for t in terms]))
    index = decontam.build_index(list(range(n)), [i.encode() for i in items], known)
    hashes, words = hash_words([t.encode() for t in texts])
    for threshold in (0.4, 0.6):
        got = {(t, index.item_ids[i]) for t, i in decontam.retrieve(index, hashes, words, threshold).tolist()}
        want = set()
        for t, text in enumerate(texts):
            w = text.split()
            for at in range(0, len(w), index.window):
                inside = set(w[at : at + 2 * index.window])
                want |= {(t, i) for i, o in enumerate(own) if sum(x for k, x in weights(o).items() if k in inside) >= threshold}
        assert got == want and want
