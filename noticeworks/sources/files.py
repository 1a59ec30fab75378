"""State, event and log files, union of sources, JSON sinks."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions.dates import parse_instant
from noticeworks.tables import names_in, store

ENTRY = "primary_key string, alias_keys array<string>, title string, org string, source string, first_seen_at string, last_seen_at string, notified_at string, announcement_date string, bid_date string, bid_deadline string, created_at string"


def _struct(schema: str) -> str:
    """Columns as the type of a struct."""
    return "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", schema) + ">"


_STRUCT = _struct(ENTRY)
STATE = f"version int, updated_at string, entries map<string,{_STRUCT}>, keys map<string,{_STRUCT}>, _corrupt_record string"
EVENT = "timestamp string, url string, outcome string, status_code int, proxy string, user_agent string, session_id string, error string, strategy string"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON state documents, of the present or the older form; broken documents give none."""
    docs = spark.read.schema(STATE).option("multiLine", True).json(path)
    new = docs.select("updated_at", F.explode("entries").alias("key", "e"), F.lit(False).alias("old"))
    old = docs.filter("entries is null").select("updated_at", F.explode("keys").alias("key", "e"), F.lit(True).alias("old"))
    rows = new.unionByName(old)
    created = F.coalesce(F.nullif("e.created_at", F.lit("")), "updated_at")
    when = lambda c: parse_instant(F.when(F.col("old"), created).otherwise(F.col(f"e.{c}")))
    text = lambda c: F.coalesce(f"e.{c}", F.lit(""))
    return rows.select(
        F.col("key").alias("primary_key"), F.when(F.col("old"), F.array("key")).otherwise(F.coalesce("e.alias_keys", F.array("key"))).alias("alias_keys"), text("title").alias("title"), text("org").alias("org"), text("source").alias("source"), when("first_seen_at").alias("first_seen_at"),
        when("last_seen_at").alias("last_seen_at"), when("notified_at").alias("notified_at"), F.try_to_date("e.announcement_date").alias("announcement_date"), F.try_to_date("e.bid_date").alias("bid_date"), text("bid_deadline").alias("bid_deadline"),
    )


#: Entries of the detail cache and of the detail queue, as their documents have them.
CACHED = (
    "primary_key string, alias_keys array<string>, title string, org string, source string, url string, official_url string, metadata map<string,string>, amount_raw string, amount_value double, budget_amount string, bid_bond string, bid_deadline string, bid_opening_time string, "
    "announcement_date string, bid_date string, status string, failure_reason string, attempt_count int, attempt_counts map<string,int>, first_seen_at string, last_attempt_at string, last_success_at string, expires_at string"
)
INSTANTS, DAYS = ("first_seen_at", "last_attempt_at", "last_success_at", "expires_at"), ("announcement_date", "bid_date")


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, key, entry): the entries of JSON documents that are written with an indent of two. An entry ends
    where its closing bracket stands four spaces in, which no text inside can hold, so Spark splits a document between
    its entries, however large it is. A broken or an empty entry has no row; its neighbours stay."""
    parts = spark.read.option("lineSep", "\n    }").text(path)
    begun = F.regexp_extract("value", r'(?s)(?:^|\n) {4}"(?:[^"\\\n]|\\.)*" ?: \{\n.*$', 0)
    body = F.concat(F.lit("{"), F.regexp_replace(begun, r"^\n", ""), F.lit("}}"))
    read = F.from_json(body, f"map<string,{_struct(schema)}>")
    return parts.filter(begun != "").select(F.col("_metadata.file_path").alias("file"), F.explode(read).alias("key", "entry")).filter("entry is not null")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """The detail cache or queue from its documents: all 24 fields, with times and days read."""
    rows = read_entries(spark, path, CACHED).select("key", "entry.*")
    read = {c: parse_instant(F.nullif(F.col(c), F.lit(""))) for c in INSTANTS} | {c: F.try_to_date(c) for c in DAYS}
    return rows.withColumns(read | {"primary_key": F.coalesce("primary_key", "key")}).drop("key")


def state_from_rows(df: DataFrame) -> DataFrame:
    """A key-value table whose alias_keys_json holds a JSON array; bad JSON is an empty one."""
    return df.withColumn("alias_keys", F.coalesce(F.from_json("alias_keys_json", "array<string>"), F.array().cast("array<string>"))).drop("alias_keys_json")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON files that hold a list, or an object with one."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>")
    inside = F.from_json("value", f"struct<events:array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>>")["events"]
    return raw.select(F.inline(F.when(F.ltrim("value").startswith("["), listed).otherwise(inside)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): lines of log files. ``pos`` rises along each file: the place of the line's block, then
    that of the line in its task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), row.alias("row")).alias("pos"), "value")


def union_sources(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all sources that could be read whole, with source and ingest_ord (source rank above the row), and
    the errors of the others. Each source is written by a job of its own, so one that fails, even at its last row, adds
    nothing and does not stop the rest. ``ingest_ord`` follows the order in which Spark reads a source."""
    out, errors = None, {}
    for rank, (name, read) in enumerate(readers.items()):
        try:
            rows = read().withColumns({"source": F.lit(name), "ingest_ord": F.lit(rank) * (1 << 52) + F.monotonically_increasing_id()})
            rows = store(rows, "source").df
        except Exception as e:  # noqa: BLE001  a source may fail in any way of its own
            errors[name] = str(e)
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, errors


def read_latest(spark: SparkSession, path: str, today: date, *, day: str = "day", back: int = 4, accept: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame | None:
    """What ``accept`` keeps of the latest day, from ``today`` back ``back`` days, that has any of it; None if none has.
    The Parquet table under ``path`` is partitioned by ``day``: days without a folder are passed over, and no other day
    than those tried is read."""
    held = set(names_in(spark, path))
    for at in (today - timedelta(i) for i in range(back + 1)):
        if f"{day}={at}" in held:
            rows = accept(spark.read.option("basePath", path).parquet(f"{path}/{day}={at}"))
            if not rows.isEmpty():
                return rows
    return None


def write_json(df: DataFrame, path: str) -> None:
    """K4, K6."""
    df.write.mode("overwrite").json(path)
