"""Duplicate resolution against a plain sequential model, and in large groups."""

from __future__ import annotations

import random
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from noticeworks.operators import dedup, link, standardize
from noticeworks.plans.monitor import complete
from noticeworks.rules import SOURCE_PRIORITY

NAMES = "ingest_ord long, title string, organization string, source string, url string, amount_value double, bid_date date, announcement_date date, summary string, backup_source string, metadata map<string,string>, tags array<string>, keyword_score double, keyword_matched_terms array<string>"
COLUMNS = [c.split(" ")[0] for c in NAMES.split(", ")]


def rank(r):
    return SOURCE_PRIORITY.get(r["source"], 1), len(r["title"]) + len(r["organization"]) + 10 * (r["amount_value"] is not None)


def blank(x):
    return not (x or "").strip()


def joined(old, new):
    """What two rows become, the earlier one (or what it has become) first."""
    win, lose = (new, old) if rank(new) > rank(old) else (old, new)
    out = dict(win, ingest_ord=old["ingest_ord"])
    sources = [s.strip() for r in (win["backup_source"], lose["backup_source"], lose["source"]) for s in (r or "").split(",")]
    out["backup_source"] = ",".join(dict.fromkeys(s for s in sources if s and s != win["source"])) or None
    out["tags"] = sorted({*win["tags"], *lose["tags"]})
    out["summary"] = max(win["summary"], lose["summary"], key=len)
    for d in ("bid_date", "announcement_date"):
        out[d] = win[d] or lose[d]
    meta = {k: v for k, v in [*lose["metadata"].items(), *win["metadata"].items()]}
    meta |= {k: v for k, v in lose["metadata"].items() if blank(win["metadata"].get(k))}
    for r in (win, lose):
        for name, plain in dedup.LOOKUPS.items():
            values = [r["metadata"].get(name), r["metadata"].get(plain), r["url"] if name.endswith("url") and "/api/tender" in r["url"] else None]
            meta[name] = meta.get(name) if not blank(meta.get(name)) else next((v for v in values if not blank(v)), None)
    best = lambda r: dedup.CONFIDENCE.get(r["metadata"].get("keyword_confidence"), -1)
    if best(lose) > best(win):
        meta |= {k: lose["metadata"][k] for k in ("keyword_confidence", "filter_source") if k in lose["metadata"]}
    out["metadata"] = {k: v for k, v in meta.items() if v is not None}
    scores = [r["keyword_score"] for r in (win, lose) if r["keyword_score"] is not None]
    out["keyword_score"] = max(scores, default=None)
    out["keyword_matched_terms"] = list(dict.fromkeys((win["keyword_matched_terms"] or []) + (lose["keyword_matched_terms"] or []))) or None
    return out


def notices(rng, n, groups):
    rows = []
    for i in range(n):
        g = rng.randrange(groups)
        meta = {k: rng.choice(["", f"v{i}", f"w{i}"]) for k in rng.sample(["a", "b", "g0v_unit_id", "unit_id", "job_number", "g0v_job_number", "tender_api_url"], rng.randrange(0, 5))}
        if rng.random() < 0.5:
            meta |= {"keyword_confidence": rng.choice(["high_confidence", "boundary", "excluded_strong"]), "filter_source": f"f{i}"}
        rows.append(
            {"ingest_ord": 3 * i, "title": f"title {g}" + "!" * rng.randrange(3), "organization": "org", "source": rng.choice(["gov_pcc", "g0v", "taiwanbuying", "other"]), "url": rng.choice([f"u{i}", f"https://x/api/tender?{i}"]), "amount_value": rng.choice([None, 5e4]),
             "bid_date": rng.choice([None, date(2026, 1, 1 + i % 28)]), "announcement_date": rng.choice([None, date(2026, 2, 1 + i % 28)]), "summary": "s" * rng.randrange(3) + rng.choice("xyz"), "backup_source": rng.choice([None, None, "mirror", "m2, mirror"]), "metadata": meta,
             "tags": rng.sample(["t1", "t2", "t3"], rng.randrange(3)), "keyword_score": rng.choice([None, float(i % 7)]), "keyword_matched_terms": rng.choice([None, rng.sample("pqrs", 2)]), "g": g}
        )
    return rows


def frame(spark, rows, more=""):
    names = [*COLUMNS, *(c.split(" ")[0] for c in more.split(", ") if c)]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], NAMES + (", " + more if more else ""))


def plain(row):
    out = row.asDict() if hasattr(row, "asDict") else dict(row)
    return {c: out[c] for c in COLUMNS}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [2, dedup.CHUNK])
def test_groups_become_what_a_sequential_merge_makes(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    rows = notices(random.Random(seed), 60, 9)
    want = {}
    for r in rows:
        want[r["g"]] = joined(want[r["g"]], r) if r["g"] in want else r
    got = {r.g: plain(r) for r in dedup.merge_groups(frame(spark, rows, "g long").repartition(3), "g").collect()}
    for g, r in want.items():
        assert got[g] == plain(r), g


def sequential_entries(rows, keys_of):
    """Row -> entry, and what the entries have become."""
    owner, entries, where = {}, {}, {}
    for r in rows:
        at = next((owner[k] for k in r["strong"] if k in owner), None)
        if at is None:
            at, entries[r["ingest_ord"]] = r["ingest_ord"], r
        else:
            entries[at] = joined(entries[at], r)
        where[r["ingest_ord"]] = at
        owner |= dict.fromkeys(keys_of(entries[at]), at)
    return where


@pytest.mark.parametrize("seed", range(4))
def test_identity_entries(spark, seed):
    rng = random.Random(seed)
    rows = notices(rng, 80, 5)
    for r in rows:
        r["strong"] = [f"source:gov_pcc:pkPmsMain:{rng.randrange(25)}"] * (rng.random() < 0.4) + [f"url:{rng.randrange(40)}"]
        r["metadata"] = {"pk": r["strong"][0]} if len(r["strong"]) > 1 else {}

    def keys_of(r):  # a merged row has its survivor's URL and its metadata's source key
        url = next(x["strong"][-1] for x in rows if x["url"] == r["url"])
        return [*([r["metadata"]["pk"]] if "pk" in r["metadata"] else []), url]

    for i, r in enumerate(rows):
        r["url"] = f"own{i}"
    want = sequential_entries(rows, keys_of)
    got = {r.ingest_ord: r.entry for r in dedup.identity_entries(frame(spark, rows, "strong array<string>").repartition(3)).collect()}
    assert got == want


def test_a_dropped_rows_url_no_longer_names_the_entry(spark):
    rows = notices(random.Random(1), 3, 1)
    for r, source, strong in zip(rows, ("g0v", "gov_pcc", "g0v"), (["source:g0v:1", "url:a"], ["source:g0v:1", "url:b"], ["url:c"]), strict=True):
        r |= {"source": source, "strong": strong, "metadata": {}}
    rows[2]["strong"] = ["source:g0v:2", "url:b"]
    assert {r.ingest_ord: r.entry for r in dedup.identity_entries(frame(spark, rows, "strong array<string>")).collect()} == {0: 0, 3: 0, 6: 0}


@pytest.mark.parametrize("seed", range(3))
def test_near_entries(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("資訊設備採購案甲乙丙丁戊己") for _ in range(22)) for _ in range(4)]
    rows = notices(rng, 70, 1)
    for r in rows:
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("子丑寅")
        r |= {"n_title": "".join(t), "n_org": rng.choice("pq"), "record_date": rng.choice([None, date(2026, 1, 1)]), "amount_value": rng.choice([None, 1e6, 1.04e6, 2e6])}
    near = lambda a, b: SequenceMatcher(None, a["n_title"], b["n_title"]).ratio() >= 0.9 and (a["amount_value"] is None or b["amount_value"] is None or abs(a["amount_value"] - b["amount_value"]) <= max(5000, 0.05 * max(a["amount_value"], b["amount_value"])))
    entries, where = [], {}
    for r in rows:
        for e in entries:
            if (e[1]["n_org"], e[1]["record_date"]) == (r["n_org"], r["record_date"]) and near(e[1], r):
                e[1] = max(e[1], r, key=rank)
                where[r["ingest_ord"]] = e[0]
                break
        else:
            entries.append([r["ingest_ord"], r])
            where[r["ingest_ord"]] = r["ingest_ord"]
    got = {r.ingest_ord: r.entry for r in dedup.near_entries(frame(spark, rows, "n_title string, n_org string, record_date date")).collect()}
    assert {i: got.get(i, i) for i in where} == where


@pytest.mark.parametrize("least", [0.8, 0.9, 0.92])
def test_prefixes_lose_no_pair(spark, least):
    rng = random.Random(6)
    titles = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 14))) for _ in range(90)]
    want = {(i, j) for j in range(90) for i in range(j) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= least}
    df = spark.createDataFrame(list(enumerate(titles)), "ingest_ord long, n_title string").withColumn("block", F.lit(None).cast("string"))
    got = [(r.a_ord, r.b_ord) for r in link.fuzzy_pairs(df, block=["block"], amount=None, least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def bids(spark, rows):
    schema = "ingest_ord long, title string, organization string, source string, url string, amount_value double, bid_date date, summary string, announcement_date date, metadata map<string,string>"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return complete(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)).withColumn("tags", F.array().cast("array<string>"))


def row(i, **more):
    return {"ingest_ord": i, "title": "資訊設備採購", "organization": "某某大學", "source": "gov_pcc", "url": f"https://example.com/{i}", "amount_value": 1_000_000.0, "bid_date": date(2026, 3, 24), "summary": "", "metadata": {}} | more


def resolved(spark, rows):
    return dedup.deduplicate(standardize.standardize_keys(bids(spark, rows))).orderBy("ingest_ord").collect()


def test_lookup_keys_survive(spark):
    meta = {"unit_id": "3.79", "g0v_job_number": "11514", "g0v_tender_api_url": "https://x/api/tender?unit_id=3.79"}
    (got,) = resolved(spark, [row(0, source="g0v", metadata=meta), row(1)])
    assert got.source == "gov_pcc" and got.backup_source == "g0v" and got.metadata == meta | {"g0v_unit_id": "3.79"}


def test_one_url_with_a_day_filled_in_joins_its_exact_group(spark):
    """The first pass fills the announcement day, and with it the exact key."""
    u = "https://x/search?pkPmsMain=AAA"
    day = date(2026, 4, 28)
    got = resolved(spark, [row(0, source="g0v", url=u, bid_date=None, announcement_date=day), row(1, url=u, bid_date=date(2026, 4, 30)), row(2, url="https://y/2", announcement_date=day)])
    assert [(r.ingest_ord, r.source, r.announcement_date) for r in got] == [(0, "gov_pcc", day)]


def test_hot_groups_follow_the_same_rule(spark):
    n = 6_000
    meta = F.when(F.col("ingest_ord") == 1, F.create_map(F.lit("unit_id"), F.lit("77"))).when(F.col("ingest_ord") == n - 1, F.create_map(F.lit("keyword_confidence"), F.lit("high_confidence"), F.lit("filter_source"), F.lit("rules"))).otherwise(F.col("metadata"))
    rows = bids(spark, [row(i, source="gov_pcc" if i == 0 else "g0v") for i in range(n)]).withColumns({"metadata": meta, "backup_source": F.when(F.col("ingest_ord") == n - 1, "mirror"), "k": F.lit(1)})
    (got,) = dedup.merge_groups(rows, "k").collect()
    assert got.ingest_ord == 0 and got.source == "gov_pcc" and got.backup_source == "g0v,mirror"
    assert got.metadata == {"unit_id": "77", "g0v_unit_id": "77", "keyword_confidence": "high_confidence", "filter_source": "rules"}


def test_chains_are_not_closed(spark):
    """A near B and B near C, but A not near C: C stays."""
    base = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"
    titles = (base, base[:18] + "一二", base[:16] + "三四一二")
    rows = standardize.standardize_keys(bids(spark, [row(i, title=titles[min(i, 2)], url=f"u{i}") for i in range(40)]))
    assert [r.ingest_ord for r in dedup.fuzzy_dedup(dedup.exact_dedup(rows)).orderBy("ingest_ord").collect()] == [0, 2]


def records_shuffled(spark, run):
    """What ``run`` returns, and the records that its stages wrote for others."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(n for k, n in stages().items() if k not in before)


def test_titles_of_a_block_are_not_written_for_each_signature(spark):
    rng = random.Random(4)
    titles = ["".join(rng.choice(["the", "and", "ing", "er", "on", "s"]) for _ in range(rng.randrange(8, 20))) for _ in range(400)]
    titles += ["x" + t for t in titles[:100]] + titles[:50]
    df = spark.createDataFrame(list(enumerate(titles)), "ingest_ord long, n_title string").withColumn("block", F.lit("b"))
    got, written = records_shuffled(spark, lambda: link.fuzzy_pairs(df, block=["block"], amount=None).collect())
    want = {(i, j, SequenceMatcher(None, titles[i], titles[j]).ratio()) for j in range(len(titles)) for i in range(j)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {x for x in want if x[2] >= 0.9}
    assert written < 20 * len(titles)


def test_parts_of_a_block_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(link, "PART", 8)
    rng = random.Random(9)
    titles = ["".join(rng.choice("abc甲乙") for _ in range(rng.randrange(0, 12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(titles)), "ingest_ord long, n_title string").withColumn("block", F.lit(None).cast("string"))
    got = [(r.a_ord, r.b_ord) for r in link.fuzzy_pairs(df, block=["block"], amount=None, least=0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for j in range(120) for i in range(j) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.8}


def test_rows_of_one_title_meet_it_once(spark):
    n = 1_500
    rows = spark.range(n).select(F.col("id").alias("ingest_ord"), F.lit("資訊設備採購").alias("n_title"), F.lit("q").alias("n_org"), F.lit(None).cast("date").alias("record_date"), F.when(F.col("id") % 2 == 0, 1e6).otherwise(5e6).alias("amount_value"), F.lit("gov_pcc").alias("source"), F.lit("t").alias("title"), F.lit("o").alias("organization"))
    got, written = records_shuffled(spark, lambda: dedup.near_entries(rows).collect())
    assert {r.ingest_ord: r.entry for r in got} == {i: i % 2 for i in range(n)}
    assert written < 20 * n


def test_passes_do_not_write_fields_that_only_stay(spark):
    """Six rows make one, by address and by exact key; a text that is only kept is moved once, at the end."""
    n, width = 600, 4_000
    rng = random.Random(2)
    texts = [f"{rng.getrandbits(4 * width):0{width}x}" for _ in range(n)]
    rows = bids(spark, [row(i, organization=f"大學{i // 6}", url=f"u{i // 2}") for i in range(n)])
    kept = spark.createDataFrame(list(enumerate(texts)), "ingest_ord long, category string")
    rows = standardize.standardize_keys(rows.drop("category").join(F.broadcast(kept), "ingest_ord"))
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in map(found.apply, range(found.size()))}

    before = stages()
    got = dedup.deduplicate(rows).select("ingest_ord", "category").collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sorted((r.ingest_ord, r.category) for r in got) == [(i, texts[i]) for i in range(0, n, 6)]
    assert sum(v for k, v in stages().items() if k not in before) < 2 * n * width
