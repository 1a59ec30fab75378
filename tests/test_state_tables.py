"""Keyed tables, the notified state, and streams whose deliveries fail."""

from __future__ import annotations

import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeworks.functions.dates import is_expired
from noticeworks.keyed import KeyedTable
from noticeworks.operators import state
from noticeworks.operators.notified import NotifiedState
from noticeworks.streaming.monitor import deliver_waiting, start_monitor
from noticeworks.streaming.outbox import Outbox

from .test_operators import bids, row

SCHEMA = "k string, v long, _gone2 string"


def written(folder) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_changes_equal_a_dictionary(spark, tmp_path):
    """Upserts and removals in any order, with compactions between them, null keys too."""
    rng = random.Random(5)
    table, model, old = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4), {}, {}
    for turn in range(1, 9):
        rows = {rng.choice(["a", "b", "c", "d", "e", None, "漢"]): rng.randrange(100) for _ in range(3)}
        gone = {k for k in rng.sample(["a", "b", "c", "x", None], 2) if k not in rows}
        frame = spark.createDataFrame([(k, v, "x") for k, v in rows.items()], SCHEMA)
        assert table.write(frame, gone=spark.createDataFrame([(k,) for k in gone], "k string")) == turn
        old[turn] = dict(model)
        model = {k: v for k, v in (model | rows).items() if k not in gone}
        if turn in (3, 6, 7):
            table.compact()
        assert {r.k: r.v for r in table.read().collect()} == model
        assert {r.k: r.v for r in table.read(before=turn).collect()} == old[turn] or turn in (3, 6, 7)
    asked = spark.createDataFrame([("a",), ("漢",), (None,), ("none",), ("a",)], "any string")
    assert {r.k: r.v for r in table.lookup(asked).collect()} == {k: v for k, v in model.items() if k in ("a", "漢", None)}
    again = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=99)
    assert again.buckets == 4 and again.read().count() == len(model)


def test_a_turn_replaces_itself_and_a_failed_write_does_not_count(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"], buckets=2)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    assert table.read().count() == 0 and table.lookup(frame(("a", 1)).select("k")).count() == 0 and table.compact() == 0
    table.write(frame(("a", 1), ("b", 1)))
    table.write(frame(("a", 2)), turn=2)
    table.write(frame(("b", 3)), turn=2)
    assert {(r.k, r.v) for r in table.read().collect()} == {("a", 1), ("b", 3)}
    table.write(frame(("a", 9)))
    os.remove(tmp_path / "t" / "delta" / "_turn=3" / "_SUCCESS")
    assert table.turn() == 2 and {(r.k, r.v) for r in table.read().collect()} == {("a", 1), ("b", 3)}


def test_writes_follow_the_batch(spark, tmp_path):
    """A state of 20,000 entries; batches of ten write a thousandth of it, and read the buckets they fall into."""
    rows = lambda ids: ids.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"], buckets=16)
    table.write(rows(spark.range(20_000)))
    table.compact()
    whole = written(tmp_path / "t" / "base")
    for i in range(3):
        table.write(rows(spark.range(i * 7, i * 7 + 10)))
        assert written(tmp_path / "t" / "delta" / f"_turn={i + 2}") < whole / 50
    assert table.read().count() == 20_000
    plan = table.lookup(rows(spark.range(1)).select("k"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(_bucket#\d+ = \d+\)", plan)


def test_notified_state_equals_one_table(spark, tmp_path):
    """Batches with crossing keys, against the operators on the whole state."""
    rng = random.Random(8)
    split, whole = NotifiedState(spark, str(tmp_path / "s"), buckets=4), spark.createDataFrame([], state.STATE_SCHEMA)
    schema = "ingest_ord long, keys array<string>, primary_key string, title string, organization string, source string, announcement_date date, bid_date date, bid_deadline string"
    for turn in range(1, 6):
        now = F.lit(datetime(2026, 1, 1)) + F.make_dt_interval(F.lit(40 * turn))
        rows = [(i, [f"k{rng.randrange(30)}" for _ in range(2)], None, f"t{turn}", "o", "s", None, None, rng.choice(["", "299/01/01"])) for i in range(6)]
        batch = spark.createDataFrame([(i, keys, keys[0], *rest) for i, keys, _, *rest in rows], schema)
        held = state.prune_state(whole, now)
        whole = spark.createDataFrame(state.mark_notified(held, state.drop_notified(batch, held), now).collect(), state.STATE_SCHEMA)
        split.take(batch, now, turn=turn)
        got = state.prune_state(split.read(), now)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.select(*got.columns).collect()))
        if turn == 3:
            split.compact(now)
    assert split.take(batch, now, turn=5) == 5  # a repeated batch
    assert sorted(map(repr, state.prune_state(split.read(), now).collect())) == sorted(map(repr, whole.collect()))


class Mail:
    """Fails as often as told, then takes what comes."""

    def __init__(self, fails: int, error: bool = False):
        self.fails, self.error, self.seen = fails, error, []

    def __call__(self, new, number):
        if self.fails:
            self.fails -= 1
            if self.error:
                raise OSError("no connection")
            return False
        self.seen.append((number, sorted(r.url for r in new.collect())))
        return True


def test_deliveries_that_fail_come_again(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    add = lambda *rows: bids(spark, list(rows)).coalesce(1).write.mode("append").parquet(at("in"))
    run = lambda mail: start_monitor(spark, at("in"), at("state"), at("outbox"), at("check"), mail, files=1).awaitTermination(240)
    add(row(0, url="u0", org="一國小"))
    mail = Mail(2)
    run(mail)  # the batch's delivery fails
    assert mail.seen == [] and Outbox(spark, at("outbox")).waiting() == [0]
    assert NotifiedState(spark, at("state")).read().count() == 0
    add(row(0, url="u0", org="一國小"), row(1, url="u1", org="二國小", title="資訊設備採購二"))
    run(mail)  # it fails again at the start; then it comes with the second batch, which has one new row
    assert mail.seen == [(0, ["u0"]), (1, ["u1"])]
    run(mail)
    assert len(mail.seen) == 2 and Outbox(spark, at("outbox")).waiting() == []
    assert NotifiedState(spark, at("state")).read().count() == 2
    with pytest.raises(Exception, match="no connection"):
        add(row(2, url="u2", org="三國小", title="資訊設備採購三"))
        run(Mail(1, error=True))
    assert Outbox(spark, at("outbox")).waiting() == [2]
    late = Mail(0)
    assert deliver_waiting(spark, at("state"), at("outbox"), late) == [] and late.seen == [(2, ["u2"])]
    run(late)  # Spark repeats the batch, which was delivered
    assert late.seen == [(2, ["u2"])]


def test_late_deadlines(spark):
    df = spark.createDataFrame([("2199/12/31 17:00",), ("299/12/31 17:00",), ("99/12/31 17:00",)], "d string")
    assert [r[0] for r in df.coalesce(1).select(is_expired(F.col("d"), F.lit("2026-01-01").cast("timestamp"))).collect()] == [False, False, True]
