"""Operators on small tables: linkage, duplicates, state, cache, logs, pages, plans."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from noticeworks.operators import dedup, digest, gate, link, logs, recall, standardize, state
from noticeworks.plans.monitor import BIDS, complete, log_report, monitor
from noticeworks.sources import api, files, pages
from noticeworks.tables import Snapshots

def now():
    return F.lit(datetime(2026, 4, 29, 12, 0))


def bids(spark, rows):
    names = [c.strip().split(" ")[0] for c in "ingest_ord long, title string, organization string, source string, url string, amount_value double, bid_date date, summary string".split(", ")]
    schema = "ingest_ord long, title string, organization string, source string, url string, amount_value double, bid_date date, summary string"
    return complete(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def row(i, title="資訊設備採購", org="某某大學", source="gov_pcc", url="", amount=1_000_000.0, day=date(2026, 3, 24), summary=""):
    return {"ingest_ord": i, "title": title, "organization": org, "source": source, "url": url, "amount_value": amount, "bid_date": day, "summary": summary}


def resolved(spark, rows):
    return dedup.deduplicate(standardize.standardize_keys(bids(spark, rows).withColumn("tags", F.array().cast("array<string>")))).orderBy("ingest_ord").collect()


def test_same_notice_from_two_sources(spark):
    got = resolved(spark, [row(0, source="g0v", url="u1"), row(1, source="gov_pcc", url="u2")])
    assert [(r.source, r.backup_source) for r in got] == [("gov_pcc", "g0v")]


def test_near_title_and_amount(spark):
    got = resolved(spark, [row(0, url="a"), row(1, title="資訊設備 採購案", amount=1_002_000.0, url="b"), row(2, title="完全不同的東西", url="c")])
    assert [r.ingest_ord for r in got] == [0, 2]


def test_same_url_merges_across_dates(spark):
    got = resolved(spark, [row(0, url="https://x/1"), row(1, title="另案", url="HTTPS://x/1 ", day=date(2026, 5, 1), summary="longer")])
    assert len(got) == 1 and got[0].summary == "longer"


def test_null_fields_and_empty_table(spark):
    assert resolved(spark, []) == []
    assert len(resolved(spark, [row(0, title=None, org=None, url=None, amount=None, day=None, summary=None), row(1, title="x", org=None, url=None, amount=None, day=None)])) == 2


def test_components_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, [f"k{rng.randrange(60)}" for _ in range(rng.randrange(0, 3))]) for i in range(80)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_key = {}
    for i, ks in rows:
        for k in ks:
            a, b = find(i), find(by_key.setdefault(k, i))
            parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(80)}
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "ingest_ord long, strong array<string>").repartition(parts)
        assert {r.ingest_ord: r.component for r in dedup.identity_components(df).collect()} == want


def test_ratio_traps(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("a" * 5 + "b" * 250, "b" * 250 + "a" * 5), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.s for r in df.select(link.ratio("a", "b").alias("s")).collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc資") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: row[j - 1] + 1 if b[j - 1] == x else max(left, row[j]), initial=0)][1:]
        assert link.common_length(a, b) == row[-1]


@pytest.mark.parametrize("n", [1, 100, 5_000, 10**7])
@pytest.mark.parametrize("least", [0.8, 0.9, 0.92])
def test_signatures_lose_no_pair(n, least):
    """For every depth, and for orders of letters that have nothing to do with the titles."""
    rng = random.Random(n)
    base = ["".join(rng.choice("abcdefgh資訊設備") for _ in range(rng.randrange(0, 45))) for _ in range(12)]
    titles = list(base)
    for t in base * 8:
        t = list(t)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "x", "資", "9"])
        titles.append("".join(t))
    counts = {x: rng.randrange(n + 1) for x in "abcdefgh資訊"}
    lengths = dict.fromkeys(map(len, titles), max(1, n // 40))
    signs = [link.title_signatures(t, counts, lengths, least) for t in titles]
    near = 0
    for i, j in itertools.permutations(range(len(titles)), 2):
        if SequenceMatcher(None, titles[i], titles[j]).ratio() >= least:
            near += 1
            assert signs[i] & signs[j], (titles[i], titles[j])
    assert near > 100


def test_numbered_titles_of_one_block(spark):
    """6,000 titles that differ in a six-digit number: under one pair in a hundred meets, and none that is near is lost."""
    rng = random.Random(1)
    numbers = rng.sample(range(10**6), 6_000)
    df = spark.createDataFrame([(i, f"資訊設備採購案{x:06d}", None) for i, x in enumerate(numbers)], "ingest_ord long, n_title string, block string").repartition(4)
    met = link.candidate_pairs(df, block=["block"], title="n_title", order="ingest_ord", amount=None, least=0.9)
    assert met.count() < 6_000 * 5_999 / 2 / 100
    got = {(r.a_ord, r.b_ord) for r in link.fuzzy_pairs(df, block=["block"], amount=None).collect()}
    for i in range(300):
        for j in range(i + 1, 3_000):
            if link.common_length(f"{numbers[i]:06d}", f"{numbers[j]:06d}") >= 4:  # others cannot be near
                near = SequenceMatcher(None, f"資訊設備採購案{numbers[i]:06d}", f"資訊設備採購案{numbers[j]:06d}").ratio() >= 0.9
                assert near == ((i, j) in got)


def test_near_targets_of_candidates(spark):
    """J3, W4 against all pairs of an organisation within a day."""
    rng = random.Random(7)
    base = ["".join(rng.choice("資訊設備採購電腦維護") for _ in range(18)) for _ in range(5)]

    def some(n):
        rows = []
        for i in range(n):
            t = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice("甲乙丙")
            rows.append((i, rng.choice("op"), "".join(t), rng.choice([None, *(date(2026, 4, d) for d in (1, 2, 3, 4))])))
        return rows

    candidates, targets, want = some(60), some(90), {}
    for c, org, title, day in candidates:
        hits = sorted((-SequenceMatcher(None, title, other).ratio(), t) for t, own, other, at in targets if own == org and day and at and abs((at - day).days) <= 1)
        hits = [(-s, t) for s, t in hits if -s >= 0.92]
        if hits:
            want[c] = (hits[0][1], 2 if len(hits) > 1 and hits[0][0] - hits[1][0] < 0.03 else 1)
    frame = lambda name, rows: spark.createDataFrame(rows, f"{name} long, n_org string, n_title string, day date")
    got = {r.cand: (r.target, r.n) for r in link.match_fuzzy(frame("cand", candidates), frame("target", targets)).collect()}
    assert got == want and len({n for _, n in want.values()}) == 2


def _side(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} long, ids array<string>, n_org string, n_title string, day date")


def test_hint_matching_stages(spark):
    day = date(2026, 4, 28)
    t = _side(spark, "target", [(10, ["a1"], "o", "電腦採購案", day), (11, [], "o", "資訊設備採購甲案", day), (12, [], "p", "網路設備採購甲乙丙丁戊己庚", day), (13, [], "q", "網路設備採購甲乙丙丁戊己庚", day), (14, [], "q", "網路設備採購甲乙丙丁戊己辛", day)])
    c = _side(spark, "cand", [(0, ["a1"], "z", "x", None), (1, [], "o", "資訊設備採購甲案", date(2026, 4, 29)), (2, [], "p", "網路設備採購甲乙丙丁戊己庚案", day), (3, [], "q", "網路設備採購甲乙丙丁戊己", day), (4, [], "o", "資訊設備採購甲案", date(2026, 5, 2)), (5, [], "z", "x", None)])
    got = {r.cand: (r.target, r.method, r.reject_reason) for r in link.match_hints(c, t).collect()}
    assert got[0] == (10, "tender_id_exact", None) and got[1] == (11, "org_title_date", None) and got[2] == (12, "org_title_fuzzy_date", None)
    assert got[3] == (None, None, "fuzzy_score_gap_too_small") and got[4] == got[5] == (None, None, None)


def test_state_round(spark, tmp_path):
    rows = standardize.standardize_keys(bids(spark, [row(0, url="u0"), row(1, title="另一案", url="u1")]))
    snapshots = Snapshots(spark, str(tmp_path / "state"))
    first = state.mark_notified(snapshots.read(state.STATE_SCHEMA), rows.filter("ingest_ord = 0"), now())
    assert snapshots.write(first) == 1
    held = snapshots.read(state.STATE_SCHEMA)
    assert [r.ingest_ord for r in state.drop_notified(rows, held).collect()] == [1]
    again = state.mark_notified(held, rows, F.lit(datetime(2026, 5, 1)))
    assert snapshots.write(again) == 2
    got = {r.title: r for r in snapshots.read(state.STATE_SCHEMA).collect()}
    assert len(got) == 2 and got["資訊設備採購"].first_seen_at == datetime(2026, 4, 29, 12) and got["資訊設備採購"].last_seen_at == datetime(2026, 5, 1)
    assert state.prune_state(snapshots.read(state.STATE_SCHEMA), F.lit(datetime(2026, 9, 1)), 90).count() == 0


def test_queue_counters(spark):
    queue = spark.createDataFrame([("k1", ["k1"], "gov_pcc", "", "", "", "pending", {"gov_pcc": 2}, "", None, None), ("k2", ["k2"], "g0v", "", "", "", "pending", {}, "", None, None)], "primary_key string, alias_keys array<string>, source string, title string, org string, url string, status string, attempt_counts map<string,int>, failure_reason string, first_seen_at timestamp, last_attempt_at timestamp")
    failures = spark.createDataFrame([("k1", "gov_pcc", "late", 2), ("k1", "gov_pcc", "early", 1)], "entry string, source string, reason string, at int")
    got = {r.primary_key: r for r in state.mark_failures(queue, failures, now()).collect()}
    assert got["k1"].attempt_counts == {"gov_pcc": 4} and got["k1"].failure_reason == "late" and got["k2"].status == "pending"
    assert [r.primary_key for r in state.pending(queue, most_attempts=2).collect()] == ["k2"]


def test_logs(spark):
    lines = ["", "2026-04-01 10:00:00,1 INFO m local_run_finished result={'new_count': 3, 'notification_sent': True}", "2026-04-01 10:00:00,1 INFO m local_run_finished result={'new_count': 3, 'notification_sent': True}", "noise", "2026-04-01 11:00:00,1 INFO m embedding_recall_done candidate_count=5 recalled=0", "2026-04-02 11:00:00,1 INFO m embedding_recall_done candidate_count=5 recalled=0"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos long, value string")
    days, streak = log_report(df)
    got = {str(r.day): r for r in days.collect()}
    assert got["2026-04-01"].runs == 1 and got["2026-04-01"].latest_run.new_count == 3 and streak.first().streak == 2
    empty = spark.createDataFrame([], "outcome string")
    assert logs.outcome_kpi(empty).first().success_rate == 0.0


def test_pages_and_api(spark):
    html = "<table><tr><th>預算金額是否公開</th><td>是</td></tr><tr><th>預算金額</th><td>1,000,000元</td></tr><tr><td>截止投標：115/04/29 17:00</td></tr></table>"
    labels = pages.page_labels(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    got = pages.pick_fields(labels).first()
    assert (got.budget, got.budget_public, got.deadline) == ("1,000,000元", "是", "115/04/29 17:00")
    payload = '{"records": [{"detail": {"採購資料:預算金額": "5,000,000元", "領投開標:是否須繳納押標金": "否"}}]}'
    detail = api.detail_fields(spark.createDataFrame([(payload,), ("broken",)], "payload string")).collect()
    assert (detail[0].amount_value, detail[0].bid_bond, detail[0].bid_deadline) == (5_000_000.0, "免繳", "無提供") and detail[1].budget_amount == "無提供"


def test_list_payload(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"unit_name": "某大學", "unit_id": "3", "job_number": "7", "date": 20260428, "url": "/index/x", "tender_api_url": "/api/tender?x", "brief": {"type": "公開招標公告", "title": "電腦"}}, {"brief": {"type": "決標公告", "title": "x"}}]}\nbroken\n')
    got = api.list_notices(api.read_lists(spark, str(tmp_path))).collect()
    assert [(r.title, r.announcement_date, r.metadata["g0v_unit_id"]) for r in got] == [("電腦", date(2026, 4, 28), "3")]


def test_state_files_of_both_forms(spark, tmp_path):
    (tmp_path / "new.json").write_text('{"version": 2, "entries": {"a": {"primary_key": "a", "alias_keys": ["a", "b"], "notified_at": "2026-01-01T00:00:00Z"}}}')
    (tmp_path / "old.json").write_text('{"keys": {"u": {"title": "t", "created_at": "2025-01-01T00:00:00"}}}')
    (tmp_path / "bad.json").write_text("{")
    got = {r.primary_key: r for r in files.read_state(spark, str(tmp_path)).collect()}
    assert got["a"].alias_keys == ["a", "b"] and got["u"].notified_at == datetime(2025, 1, 1) and len(got) == 2


def test_sources_are_isolated(spark):
    def broken():
        raise OSError("down")

    rows, errors = files.union_sources({"a": lambda: spark.createDataFrame([(1,)], "x int"), "b": broken})
    assert rows.count() == 1 and errors == {"b": "down"}


def test_recall_ties_take_the_lowest_index(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [1.0, 0.0], 3), (3, [0.0, 0.0], 3)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.category, round(r.similarity, 6)) for r in recall.best_category(vectors, recall.category_vectors(vectors), row="vec_id").collect()}
    assert got == {1: (3, 1.0), 2: (3, 1.0), 3: (3, 0.0)}


def test_digest(spark):
    df = spark.createDataFrame([(0, "無"), (1, "115/05/02"), (2, "115/04/30 17:00")], "ingest_ord long, bid_deadline string")
    assert digest.earliest_deadline(df).first().earliest == "2026/04/30 17:00"


def test_ranking_is_stable(spark):
    df = spark.createDataFrame([(0, "", date(2026, 1, 1), None), (1, "high", None, 5.0), (2, "", date(2026, 1, 2), None), (3, "", date(2026, 1, 1), None)], "ingest_ord long, ai_priority string, bid_date date, amount_value double").withColumn("announcement_date", F.lit(None).cast("date"))
    assert [r.ingest_ord for r in gate.rank_notifications(df).collect()] == [1, 2, 0, 3]


def test_monitor_end_to_end(spark):
    rows = bids(spark, [row(0, url="u0"), row(1, title="資訊設備採購", source="g0v", url="u1"), row(2, title="消防設備", url="u2"), row(3, title="筆記型電腦", org="某某國小", url="u3", day=None)])
    empty = spark.createDataFrame([], state.STATE_SCHEMA)
    first = monitor(rows, empty, now())
    assert [r.title for r in first.new.collect()] == ["資訊設備採購", "筆記型電腦"]
    assert [r.n for r in first.funnel.orderBy("stage").collect()] == [4, 3, 2, 2]
    assert monitor(rows, first.state, now()).new.count() == 0
    assert monitor(spark.createDataFrame([], BIDS), empty, now()).new.count() == 0


def test_the_last_value_of_a_day_over_files(spark):
    line = lambda at, n: f"2026-04-01 {at},000 INFO bid keyword_screen_distribution high_confidence={n} boundary=1"
    run = """2026-04-01 08:00:00,000 INFO bid local_run_finished result={'new_count': 3, 'source_status': [{'source': 'x', 'success': False, 'error': "can't"}]}"""
    rows = [("a.log", 70, line("09:00:00", 1)), ("a.log", 71, run), ("b.log", 1, line("20:00:00", 2)), ("b.log", 2, line("20:00:00", 3)), ("b.log", 3, "2026-04-01 20:00:01,000 INFO bid local_run_finished result={'new_count': broken}"), ("c.log", 900, line("07:00:00", 4))]
    got = logs.daily_rollup(logs.scan_log(spark.createDataFrame(rows, "file string, pos long, value string"))).first()
    assert got.keyword_high == 3 and got.runs == 2 and got.latest_run.new_count == 3 and got.latest_run.source_status[0].error == "can't"


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    """A file of many blocks, and files that share a task: ``pos`` follows the lines."""
    for name, n in (("a.log", 4000), ("b.log", 3), ("c.log", 40)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(n)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = files.read_log(spark, str(tmp_path)).orderBy("file", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    by = {}
    for r in got:
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(int(r.value))
    assert by == {"a.log": list(range(4000)), "b.log": [0, 1, 2], "c.log": list(range(40))}


def test_a_source_that_fails_at_its_last_row_does_not_stop_the_rest(spark):
    bad = lambda: spark.range(0, 3000, 1, 3).select(F.when(F.col("id") == 2999, F.raise_error(F.lit("broken"))).otherwise("x").alias("x"))
    gone = lambda: spark.read.parquet("/nowhere/at/all")
    good = lambda: spark.range(2).select(F.col("id").cast("string").alias("x"))
    rows, errors = files.union_sources({"good": good, "bad": bad, "gone": gone, "more": good})
    assert sorted((r.source, r.x) for r in rows.collect()) == [("good", "0"), ("good", "1"), ("more", "0"), ("more", "1")]
    assert rows.select("ingest_ord").distinct().count() == 4 and set(errors) == {"bad", "gone"} and "broken" in errors["bad"]
    assert files.union_sources({"bad": bad})[0] is None


def test_prompts_are_asked_once(spark, tmp_path):
    """Equal prompts, later calls and rounds ask nothing twice; what fails is tried again, at last by the next call."""
    from noticeworks.keyed import KeyedTable
    from noticeworks.operators import replies

    at = str(tmp_path)

    def make():
        import os
        import uuid

        def score(prompts):
            for p in prompts:
                open(f"{at}/call-{p}-{uuid.uuid4().hex}", "w").close()
            calls = sum(f.startswith("call-bad") for f in os.listdir(at))
            if "bad" in prompts and calls < 4 or "slow" in prompts and sum(f.startswith("call-slow") for f in os.listdir(at)) < 2:
                raise OSError("busy")
            return [f"to {p}" for p in prompts]

        return score

    held = KeyedTable(spark, f"{at}/held", replies.REPLIES, ["hash"], buckets=2)
    asked = lambda *prompts: spark.createDataFrame(list(enumerate(prompts)), "ingest_ord long, prompt string").repartition(3)
    ask = lambda df: {r.ingest_ord: r.reply for r in replies.ask(df, make, held, name=at, size=1, tries=3, wait=0.01, per_round=2).collect()}
    calls = lambda p: len([f for f in tmp_path.iterdir() if f.name.startswith(f"call-{p}-")])
    assert ask(asked("a", "b", "a", None, "slow", "bad", "c")) == {0: "to a", 1: "to b", 2: "to a", 4: "to slow", 6: "to c"}
    assert [calls(p) for p in ("a", "b", "c", "slow", "bad")] == [1, 1, 1, 2, 3]
    assert ask(asked("a", "d", "bad")) == {0: "to a", 1: "to d", 2: "to bad"}
    assert [calls(p) for p in ("a", "d", "bad")] == [1, 1, 4]
    assert ask(asked()) == {} and ask(asked("a")) == {0: "to a"}


def test_documents_are_read_entry_by_entry(spark, tmp_path):
    """Many tasks share one document; texts hold brackets, quotes and breaks; a broken entry costs itself alone."""
    import json

    entries = {f"k{i}": {"primary_key": f"k{i}", "title": f'a "title" {{\n    }},\n    "k": {{ 臺 \\ {i}', "alias_keys": [f"k{i}", "x"], "attempt_counts": {"g0v": i}, "amount_value": i / 2, "first_seen_at": "2026-04-01T10:00:00Z", "bid_date": "2026-04-02", "expires_at": ""} for i in range(500)}
    entries |= {'odd "key"\n': {"title": "t"}, "empty": {}}
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "entries": entries, "updated_at": "x"}, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"entries": {"p": {"title": "p"}, "q": {"title": "q"}, "r": {"title": "r"}}}, indent=2).replace('"title": "q"', '"title": q'), encoding="utf-8")
    (tmp_path / "c.json").write_text("", encoding="utf-8")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = files.read_details(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 20 and len(read.columns) == 24
        got = {r.primary_key: r for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert set(got) == {*entries, "p", "r"} - {"empty"}
    assert all(got[k].title == e["title"] for k, e in entries.items() if e)
    assert got["k7"].attempt_counts == {"g0v": 7} and got["k7"].amount_value == 3.5 and got["k7"].bid_date == date(2026, 4, 2) and got["k7"].expires_at is None


def test_the_latest_day_is_the_one_folder_read(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(date(2026, 4, d), k) for d, k in ((1, "a"), (2, "a"), (3, "b"), (9, "a"))]
    spark.createDataFrame(rows, "day date, kind string").write.partitionBy("day").parquet(path)
    read = lambda d, **more: files.read_latest(spark, path, date(2026, 4, d), **more)
    wanted = lambda df: df.filter("kind = 'a'")
    got = read(5, accept=wanted)
    assert [(r.day, r.kind) for r in got.collect()] == [(date(2026, 4, 2), "a")] and all("day=2026-04-02" in f for f in got.inputFiles())
    assert read(5).first().kind == "b" and read(8) is None and read(8, back=5).first().kind == "b"


def test_repeats_are_dropped_over_chunks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice(["f", "g", None]), rng.choice(["a", "b", "", None])) for i in range(300)]
    want = []
    for f in ("f", "g", None):
        last = None
        for i, own, v in rows:
            if own == f and v:
                want += [i] if v != last else []
                last = v
    for chunk in (1, 7, 1 << 14):
        monkeypatch.setattr(logs, "CHUNK", chunk)
        df = spark.createDataFrame(rows, "pos long, file string, value string").repartition(3)
        assert sorted(r.pos for r in logs.drop_repeated(df, value="value", partition=["file"], order="pos").collect()) == sorted(want)
