"""Run logs and crawl events: scan, daily rollup, streaks, outcome rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeworks.functions.text import log_literal, log_number

LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+\s+(\w+)\s+(\S+)\s+(\S+)(.*)$"
OUTCOMES = ["success", "captcha", "hard_block", "access_denied", "soft_block", "rate_limited", "cloudflare_challenge", "timeout", "empty_content", "redirect_challenge"]
TERMINAL, RECOVERABLE = ["captcha", "hard_block", "access_denied"], ["rate_limited", "cloudflare_challenge", "soft_block"]
RUN_SCHEMA = "crawled_count int, filtered_count int, deduped_count int, new_count int, notification_sent boolean, source_status array<struct<source:string,success:boolean,count:int,error:string>>"
FAILURES = ["embedding_model_load_failed", "embedding_recall_failed", "source_failed", "notification_failed", "embedding_ab_failed"]


#: Rows of a partition whose neighbours are looked up together.
CHUNK = 1 << 14


def _chunk(df: DataFrame, order: str) -> Column:
    """The chunk that a row's place falls into; places are numbers, or (block, row) as ``read_log`` gives them."""
    last = F.col(order)
    if isinstance(df.schema[order].dataType, StructType):
        block, row = df.schema[order].dataType.names
        return F.struct(last[block].alias("b"), F.floor(last[row] / CHUNK).alias("r"))
    return F.struct(F.lit(0).alias("b"), F.floor(last / CHUNK).alias("r"))


def drop_repeated(df: DataFrame, *, value: str, partition: list[str], order: str) -> DataFrame:
    """Rows whose value equals that of the row before; empty values are dropped and do not come between.

    The row before is looked up inside chunks of CHUNK places, and for a chunk's first row among the chunks' last
    values, so one long partition is spread over tasks."""
    rows = df.filter(F.coalesce(F.col(value), F.lit("")) != "").withColumn("_chunk", _chunk(df, order))
    ends = rows.groupBy(*partition, "_chunk").agg(F.max_by(value, order).alias("_end"))
    before = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*partition).orderBy("_chunk")))
    last = F.lag(value).over(Window.partitionBy(*partition, "_chunk").orderBy(order))
    names = [*partition, "_chunk"]
    before = before.select(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(names)), "_end")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    joined = rows.join(before, same, "left")
    return joined.withColumn("_last", F.coalesce(last, "_end")).filter(~F.col(value).eqNullSafe(F.col("_last"))).select(*df.columns)


def scan_log(lines: DataFrame, *, line: str = "value", file: str = "file", pos: str = "pos") -> DataFrame:
    """(file, pos, ts, level, logger, event, extra); lines of another form are dropped, and so are repeats."""
    kept = drop_repeated(lines, value=line, partition=[file], order=pos).filter(F.col(line).rlike(LINE))
    part = lambda i: F.regexp_extract(line, LINE, i)
    return kept.select(file, pos, F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("event"), part(5).alias("extra"))


def daily_rollup(log: DataFrame, *, file: str = "file", pos: str = "pos") -> DataFrame:
    """A row for each day: runs and the last run, last keyword counts, sums, warnings, failure events. Of several
    files of a day the last line is the latest one; of lines of one second that of the last file, then of the last place."""
    place = F.struct("ts", file, pos)
    is_event = lambda e: F.col("event") == e
    number = lambda k: log_number(F.col("extra"), k)
    last = lambda v, when: F.max_by(v, F.when(when, place))
    done_run, keyword, bond, applied, done = (is_event(e) for e in ("local_run_finished", "keyword_screen_distribution", "bid_bond_unparsed_summary", "embedding_recall_applied", "embedding_recall_done"))
    run = F.from_json(F.nullif(log_literal(F.when(done_run, F.col("extra")), "result", anywhere=True), F.lit("{}")), RUN_SCHEMA)
    total = lambda v, when: F.coalesce(F.sum(F.when(when, F.coalesce(v, F.lit(0)))), F.lit(0))
    candidates = F.when(applied, number("original")).when(done, number("candidate_count"))
    read = log.withColumn("_run", run)  # once a row
    run = F.col("_run")
    return read.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(done_run).alias("runs"), last(run, run.isNotNull()).alias("latest_run"),
        last(number("high_confidence"), keyword).alias("keyword_high"), last(number("boundary"), keyword).alias("keyword_boundary"), last(number("included_total"), keyword).alias("keyword_included_total"),
        last(number("unparsed_count"), bond & number("unparsed_count").isNotNull()).alias("bond_unparsed"), F.count_if(applied).alias("applied_runs"), F.count_if(done).alias("recall_runs"),
        total(candidates, applied | done).alias("candidates_total"), total(number("recalled"), applied | done).alias("recalled_total"), F.count_if(is_event("embedding_duration_warning")).alias("duration_warnings"), F.count_if(is_event("embedding_memory_warning")).alias("memory_warnings"),
        F.array_sort(F.collect_set(F.when(F.col("event").isin(FAILURES), F.col("event")))).alias("failure_events"),
    )


def run_sources(run: Column) -> Column:
    """struct(ok, failed) of the last run's sources."""
    status = F.coalesce(run["source_status"], F.array())
    return F.struct(F.size(F.filter(status, lambda s: s["success"])).alias("ok"), F.size(F.filter(status, lambda s: ~s["success"])).alias("failed"))


def last_days(days: DataFrame, n: int, *, day: str = "day") -> DataFrame:
    """T4: the last n days that there are; all if n is 0 or less."""
    return days.orderBy(F.desc(day)).limit(n) if n > 0 else days


def zero_streak(days: DataFrame, *, observed: Column, zero: Column, day: str = "day") -> DataFrame:
    """One row: the number of latest days in a row that were observed and zero. Only days in the table count.

    A day belongs if no day from it on breaks the streak, so the latest breaking day decides; no window is needed."""
    good = F.coalesce(observed & zero, F.lit(False))
    last_break = days.agg(F.max(F.when(~good, F.col(day))).alias("broken"))
    return days.join(F.broadcast(last_break)).agg(F.count_if(F.col("broken").isNull() | (F.col(day) > F.col("broken"))).alias("streak"))


def outcome_kpi(events: DataFrame, *, outcome: str = "outcome") -> DataFrame:
    """One row: total, a count for each outcome, others, and rates in percent (0 if there are no events)."""
    o = F.col(outcome)
    rate = lambda names: F.when(F.count("*") > 0, 100.0 * F.count_if(o.isin(names)) / F.count("*")).otherwise(0.0)
    counts = [F.count_if(o == name).alias(f"n_{name}") for name in OUTCOMES]
    other = F.count_if(o.isNull() | ~o.isin(OUTCOMES)).alias("n_unknown_failure")
    return events.agg(F.count("*").alias("total"), *counts, other, rate(["success"]).alias("success_rate"), rate(TERMINAL).alias("terminal_rate"), rate(RECOVERABLE).alias("recoverable_rate"))


def success_by(events: DataFrame, dimensions: list[str], *, success: Column) -> DataFrame:
    """Success counts by several dimensions in one scan: dimension, value, total, success, rate; best first."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions))).alias("d")
    counted = events.select(each, F.coalesce(success, F.lit(False)).alias("ok")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("total"), F.count_if("ok").alias("success"))
    return counted.withColumn("rate", 100.0 * F.col("success") / F.col("total")).orderBy("dimension", F.desc("rate"), "value")
