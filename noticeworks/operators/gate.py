"""The gate: which notices are kept, with type and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import classify as C
from noticeworks.functions.dates import effective_day, is_expired
from noticeworks.functions.text import text
from noticeworks.rules import DEFAULT, RulePack

CLOSED = "已結標|已截止|決標|流標|廢標"


def _metadata(df: DataFrame, key: str) -> Column:
    return F.col("metadata")[key] if "metadata" in df.columns else F.lit(None).cast("string")


def filter_notices(df: DataFrame, pack: RulePack = DEFAULT) -> DataFrame:
    """Rows that pass the gate, with unit_type and tags. One pass, no shuffle. Null texts are empty."""
    hint = _metadata(df, "category_hint")
    args = ("title", "summary", "category")
    title, summary, category = (F.col(c) if c in df.columns else F.lit("") for c in args)
    org = F.col("organization")
    kept = df.filter(C.passes_gate(title, org, summary, category, hint, pack))
    return kept.withColumns({"unit_type": C.unit_type(org, pack), "tags": C.theme_tags(title, summary, category, pack, hint)})


def drop_closed(df: DataFrame, today: Column, *, day: str = "bid_date", shown: str = "date_text") -> DataFrame:
    """Listings that are over by date or by their words."""
    return df.filter(~(F.coalesce(F.col(day) < today, F.lit(False)) | text(F.col(shown)).rlike(CLOSED)))


def drop_expired(df: DataFrame, now: Column, *, deadline: str = "bid_deadline") -> DataFrame:
    """P10."""
    return df.filter(~is_expired(F.col(deadline), now))


def drop_candidates(df: DataFrame, *, flag: str = "candidate_only") -> DataFrame:
    """Only true blocks."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """A1, A8."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def tag_histogram(df: DataFrame, *, tags: str = "tags", order: str = "ingest_ord") -> DataFrame:
    """A2: tags by falling count; of equal counts the one seen first. ``place`` is the rank."""
    counted = df.select(F.posexplode(tags).alias("at", "tag"), order).groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").select("tag", "n")


def with_reason(df: DataFrame, today: Column, recent_days: int = 3) -> DataFrame:
    """C9."""
    return df.withColumn("notification_reason", C.notification_reason(effective_day(F.col("announcement_date"), F.col("bid_date")), today, recent_days))


def rank_notifications(df: DataFrame, *, order: str = "ingest_ord") -> DataFrame:
    """By priority, known date, date and amount, all falling; equal rows keep their order."""
    day = effective_day(F.col("announcement_date"), F.col("bid_date"))
    priority = F.when(F.col("ai_priority") == "high", 3).when(F.col("ai_priority") == "medium", 2).when(F.col("ai_priority") == "low", 1).otherwise(0)
    return df.orderBy(priority.desc(), day.isNotNull().desc(), day.desc_nulls_last(), F.coalesce("amount_value", F.lit(0.0)).desc(), order)


def source_health(df: DataFrame, sources: list[str], *, least: int = 5, errors: dict[str, str] | None = None) -> DataFrame:
    """A row for each source with its count and state; ``alert`` is set on all rows if none is up or too few came."""
    spark = df.sparkSession
    known = spark.createDataFrame([(s, (errors or {}).get(s, "")) for s in sources], "source string, error string")
    counted = known.join(df.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), "error")
    total = counted.agg(F.sum("n").alias("total"), F.max(F.col("n") > 0).alias("any"))
    return counted.join(F.broadcast(total)).select("source", "n", "error", (F.col("n") > 0).alias("ok"), (~F.col("any") | (F.col("total") < least)).alias("alert"))


def run_funnel(**stages: DataFrame) -> DataFrame:
    """A10: a row for each stage, in order, with its number of rows. Stages are best given as written tables, which are
    counted from their footers; metrics observed on the way would count a task again that a lost executor repeats."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("stage"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
