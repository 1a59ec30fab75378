"""What a digest shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.amounts import format_amount
from noticeworks.functions.dates import deadline_order, show_deadline
from noticeworks.functions.text import display_sources, first_text, is_missing, sanitize, strip, text

SOURCE_NAMES = {"gov_pcc": "政府採購網", "g0v": "g0v 開放資料", "taiwanbuying": "台灣採購公報", "detail_cache": "細節快取"}
UNPARSED_BONDS = ["", "需繳納", "未公開"]


def earliest_deadline(df: DataFrame, *, deadline: str = "bid_deadline", order: str = "ingest_ord") -> DataFrame:
    """A3: one row, the earliest deadline as shown; null if no row has one."""
    known = df.filter(~is_missing(F.col(deadline)))
    return known.agg(F.min_by(show_deadline(F.col(deadline)), F.struct(deadline_order(F.col(deadline)).alias("at"), F.col(order).alias("o"))).alias("earliest"))


def subject(prefix: str, day: Column, count: Column, earliest: Column) -> Column:
    """C19."""
    tail = F.when(text(earliest) != "", F.concat(F.lit(" | 最早截止 "), earliest)).otherwise("")
    return F.concat(F.lit(prefix), F.lit(" "), day.cast("string"), F.lit(" | "), count.cast("string"), F.lit(" 筆"), tail)


def digest_cards(df: DataFrame) -> DataFrame:
    """C17: the values of a card, with their fallbacks."""
    return df.withColumns(
        {
            "shown_budget": first_text(F.col("budget_amount"), format_amount(F.col("amount_value"), F.col("amount_raw")), F.lit("未提供")),
            "shown_bond": F.when(is_missing(F.col("bid_bond")), "未提供").otherwise(strip(F.col("bid_bond"))),
            "shown_deadline": F.when(is_missing(F.col("bid_deadline")), "未提供").otherwise(show_deadline(F.col("bid_deadline"))),
            "shown_source": display_sources(F.col("source"), SOURCE_NAMES),
            "has_link": text(F.col("url")).rlike("^https?://"),
        }
    )


def tracking_payload(df: DataFrame, labels: list[str]) -> DataFrame:
    """C20: a JSON payload for each high-priority row; titles over 256 characters end in dots."""
    title = F.when(F.length("title") > 256, F.concat(F.left("title", F.lit(253)), F.lit("..."))).otherwise(F.col("title"))
    body = F.concat_ws("\n", F.concat(F.lit("機關: "), "organization"), F.concat(F.lit("截止: "), text(F.col("bid_deadline"))), F.concat(F.lit("連結: "), text(F.col("url"))))
    return df.filter(F.col("ai_priority") == "high").select("*", F.to_json(F.struct(title.alias("title"), body.alias("body"), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"))).alias("payload"))


def unparsed_bonds(df: DataFrame, *, limit: int = 80, top: int = 5, samples: int = 3, order: str = "ingest_ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(count, commonest texts, first samples) of bonds that are stated but were not understood."""
    rows = df.filter((strip(F.col("bid_bond_raw")) != "") & strip(F.col("bid_bond")).isin(UNPARSED_BONDS)).withColumn("raw", sanitize(F.col("bid_bond_raw"), limit))
    patterns = rows.filter("raw <> ''").groupBy("raw").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(top).select("raw", "n")
    first = rows.orderBy(order).limit(samples).select(F.left("title", F.lit(200)).alias("title"), F.left("organization", F.lit(120)).alias("organization"), "url", "raw", "bid_bond")
    return rows.agg(F.count("*").alias("unparsed_count")), patterns, first


def link_states(df: DataFrame, *, state: str = "link_state") -> DataFrame:
    """A5: one row of counts; unknown states are unresolved."""
    s = F.lower(strip(F.col(state)))
    good = lambda v: F.count_if(s == v)
    return df.agg(F.count("*").alias("n"), good("resolved_official").alias("resolved_official"), good("fallback_api").alias("fallback_api"), F.count_if(~s.isin("resolved_official", "fallback_api")).alias("unresolved"))


def field_misses(df: DataFrame, *, fields: dict[str, str], unread: dict[str, Column] | None = None, snippet: str = "snippet") -> DataFrame:
    """A row for each detail field that is empty or was not understood: field, reason, title, url, snippet."""
    checks = [
        F.struct(F.lit(name).alias("field"), F.when((unread or {}).get(c, F.lit(False)), "parse_failed").when(strip(F.col(c)) == "", "label_not_found_or_empty").alias("reason"))
        for c, name in fields.items()
    ]
    rows = df.select(F.left("title", F.lit(80)).alias("title"), "url", F.left(text(F.col(snippet)), F.lit(240)).alias("snippet"), F.inline(F.array(*checks)))
    return rows.filter(F.col("reason").isNotNull()).select("field", "reason", "title", "url", "snippet")
