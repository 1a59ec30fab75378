"""Four table jobs over notice-like rows, one projection each, with a metric row of what could not be read (2.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import amounts as A
from noticeworks.functions import dates as D
from noticeworks.functions import keys as K
from noticeworks.functions import text as X


def standardize_keys(df: DataFrame, *, compose: bool = True, title: str = "title", org: str = "organization", url: str = "url", amount: str = "amount_value", raw: str = "amount_raw", due: str = "bid_date", announced: str = "announcement_date", metadata: str = "metadata") -> DataFrame:
    """Adds n_title, n_org, amount_key, record_date, keys, primary_key and exact_key."""
    n = lambda c: X.normalize_text(F.col(c), compose=compose)
    named = df.withColumns({"n_title": n(title), "n_org": n(org), "_raw": n(raw)})
    named = named.withColumns({"amount_key": A.amount_key(F.col(amount), F.col("_raw")), "record_date": D.effective_day(F.col(announced), F.col(due))}).drop("_raw")
    # As columns, so that what several keys need is found once a row.
    parts = K.source_parts(F.col(metadata), F.col(url)) | {"link": X.strip(F.col(url))}
    named = named.withColumns({f"_{k}": c for k, c in parts.items()})
    keys = K.notification_keys(title=F.col("n_title"), org=F.col("n_org"), amount=F.col("amount_key"), announced=F.col(announced), due=F.col(due), url=F.col("_link"), metadata=F.col(metadata), uid=F.col("uid") if "uid" in df.columns else None, compose=compose, parts={k: F.col(f"_{k}") for k in parts})
    named = named.withColumn("keys", keys).drop(*(f"_{k}" for k in parts))
    return named.withColumns({"primary_key": K.primary_key(F.col("keys")), "exact_key": K.exact_key(F.col("n_title"), F.col("n_org"), F.col(announced), F.col(due), F.col("amount_key"))})


def standardize_amounts(df: DataFrame, *, raw: str = "amount_raw", bond: str | None = None, compose: bool = True) -> DataFrame:
    """Adds amount_value, amount_shown and, with ``bond``, bid_bond."""
    value = A.parse_amount(X.nfkc(F.col(raw)) if compose else F.col(raw))
    out = df.withColumn("amount_value", value).withColumn("amount_shown", A.format_amount(F.col("amount_value"), F.col(raw)))
    return out.withColumn("bid_bond", A.bond_value(F.col(bond))) if bond else out


def standardize_dates(df: DataFrame, *, day: str, deadline: str, now: Column, compose: bool = True) -> DataFrame:
    """Adds parsed_date, deadline (struct), deadline_shown and expired."""
    n = lambda c: X.nfkc(F.col(c)) if compose else F.col(c)
    return df.withColumns({"parsed_date": D.parse_day(n(day)), "deadline": D.parse_deadline(n(deadline)), "deadline_shown": D.show_deadline(n(deadline)), "expired": D.is_expired(n(deadline), now)})


def standardize_links_and_status(df: DataFrame, *, url: str = "url", metadata: str = "metadata", parameters: list[str] | None = None) -> DataFrame:
    """Adds url_key, lookup (struct), a column for each of ``parameters`` and link_state."""
    added = {"url_key": X.url_key(F.col(url)), "lookup": X.lookup_url(F.col(metadata), F.col(url))}
    added |= {f"q_{p}": X.query_value(F.col(url), p) for p in parameters or []}
    return df.withColumns(added).withColumn("link_state", X.human_url(F.col(metadata)["official_url"], F.col("lookup.url"), F.col(metadata)["g0v_raw_url"])["state"])


def reject_rates(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A row for each parsed column: rows, rows with raw text, and rows whose text could not be read."""
    out = None
    for parsed, raw in pairs.items():
        has = X.strip(F.col(raw).cast("string")) != ""
        row = df.agg(F.count("*").alias("rows"), F.count_if(has).alias("filled"), F.count_if(has & F.col(parsed).isNull()).alias("unread")).select(F.lit(parsed).alias("field"), "rows", "filled", "unread")
        out = row if out is None else out.unionByName(row)
    return out
