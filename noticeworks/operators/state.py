"""Notified state and detail cache as tables: alias index, upserts, pruning, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import classify as C
from noticeworks.functions.dates import parse_deadline
from noticeworks.functions.text import MISSING_CACHED, append_source, is_missing

STATE_SCHEMA = "primary_key string, alias_keys array<string>, title string, org string, source string, first_seen_at timestamp, last_seen_at timestamp, notified_at timestamp, announcement_date date, bid_date date, bid_deadline string"
DETAILS = ("budget_amount", "amount_raw", "bid_bond", "bid_deadline", "bid_opening_time")


def alias_index(entries: DataFrame) -> DataFrame:
    """(key, entry): any name of an entry; of several entries the greatest primary key counts."""
    names = F.array_union(F.array("primary_key"), F.filter(F.coalesce("alias_keys", F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "")))
    return entries.select(F.col("primary_key").alias("entry"), F.explode(names).alias("key")).groupBy("key").agg(F.max("entry").alias("entry"))


def all_keys(entries: DataFrame) -> DataFrame:
    """E3, I1."""
    return alias_index(entries).select("key")


def drop_notified(df: DataFrame, entries: DataFrame, *, row: str = "ingest_ord", keys: str = "keys") -> DataFrame:
    """Rows of which no key was notified."""
    hit = df.select(row, F.explode(keys).alias("key")).join(all_keys(entries), "key", "left_semi").select(row).distinct()
    return df.join(hit, row, "left_anti")


def resolve(df: DataFrame, entries: DataFrame, *, row: str = "ingest_ord", keys: str = "keys") -> DataFrame:
    """(row, entry): the entry of the first key in the index; rows without one have no row."""
    asked = df.select(row, F.posexplode(keys).alias("at", "key"))
    return asked.join(alias_index(entries), "key").groupBy(row).agg(F.min_by("entry", "at").alias("entry"))


def _targets(df: DataFrame, entries: DataFrame, row: str, by_alias: bool) -> DataFrame:
    if not by_alias:
        return df.withColumn("entry", F.col("primary_key"))
    found = resolve(df, entries, row=row)
    return df.join(found, row, "left").withColumn("entry", F.coalesce("entry", "primary_key"))


def mark_notified(entries: DataFrame, batch: DataFrame, now: Column, *, row: str = "ingest_ord", by_alias: bool = True) -> DataFrame:
    """J8 (J9 without ``by_alias``): entries after a batch. Aliases unite, the last row describes, first times stay.

    Rows resolve against the entries as they were before the batch."""
    return _upsert(entries, batch, now, row, by_alias, "full_outer")


def changed_entries(entries: DataFrame, batch: DataFrame, now: Column, *, row: str = "ingest_ord", by_alias: bool = True) -> DataFrame:
    """Those entries of ``mark_notified`` that the batch adds or changes."""
    return _upsert(entries, batch, now, row, by_alias, "right_outer")


def _upsert(entries: DataFrame, batch: DataFrame, now: Column, row: str, by_alias: bool, how: str) -> DataFrame:
    named = _targets(batch, entries, row, by_alias)
    # Keys repeat from row to row, so they are made distinct before they are gathered.
    names = named.select("entry", F.explode(F.concat(F.array("entry", "primary_key"), F.col("keys"))).alias("key")).distinct().groupBy("entry").agg(F.array_sort(F.collect_list("key")).alias("aliases"))
    new = named.groupBy("entry").agg(
        F.max_by(F.struct(F.left("title", F.lit(300)).alias("title"), F.left("organization", F.lit(240)).alias("org"), "source", "announcement_date", "bid_date", "bid_deadline"), row).alias("n"),
    ).join(names, "entry")
    old = entries.select(F.col("primary_key").alias("entry"), F.struct(*entries.columns).alias("o"))
    both = old.join(new, "entry", how)
    is_new = F.col("n").isNotNull()
    pick = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    held = F.coalesce("o.alias_keys", F.array().cast("array<string>"))
    first = F.when(is_new, now).otherwise(F.col("o.first_seen_at")) if not by_alias else F.coalesce("o.first_seen_at", now)
    return both.select(
        F.col("entry").alias("primary_key"), F.when(is_new, F.array_sort(F.array_union(held, F.col("aliases")) if by_alias else F.col("aliases"))).otherwise(held).alias("alias_keys"), pick("title").alias("title"), pick("org").alias("org"), pick("source").alias("source"),
        first.alias("first_seen_at"), F.when(is_new, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"), F.coalesce("o.notified_at", F.when(is_new, now)).alias("notified_at"), pick("announcement_date").alias("announcement_date"), pick("bid_date").alias("bid_date"), pick("bid_deadline").alias("bid_deadline"),
    )


def prune_state(entries: DataFrame, now: Column, retention_days: int = 90) -> DataFrame:
    """Entries notified before the cutoff go if their deadline is missing, unreadable or past."""
    over = F.coalesce(parse_deadline(F.col("bid_deadline"))["d"] < F.to_date(now), F.lit(True))
    old = F.coalesce(F.col("notified_at") < now - F.make_dt_interval(F.lit(max(retention_days, 1))), F.lit(False))
    return entries.filter(~(old & over))


def cache_entries(df: DataFrame, status: str, now: Column) -> DataFrame:
    """Notices with keys and primary_key as entries of the detail cache or queue: 24 fields, titles cut to 300 and
    organisations to 240. A link that was only a fallback gives the official one of the metadata."""
    state_of, human = F.col("metadata")["g0v_link_resolution_state"], F.col("metadata")["g0v_human_url"]
    official = F.when(state_of == "fallback_api", F.coalesce(F.nullif(human, F.lit("")), "url")).otherwise(F.col("url"))
    none = F.lit(None).cast("timestamp")
    return df.select(
        "primary_key", F.col("keys").alias("alias_keys"), F.left("title", F.lit(300)).alias("title"), F.left("organization", F.lit(240)).alias("org"), "source", "url", official.alias("official_url"), "metadata", "amount_raw", "amount_value", "budget_amount", "bid_bond", "bid_deadline", "bid_opening_time",
        "announcement_date", "bid_date", F.lit(status).alias("status"), F.lit("").alias("failure_reason"), F.lit(0).alias("attempt_count"), F.create_map().cast("map<string,int>").alias("attempt_counts"), now.alias("first_seen_at"), none.alias("last_attempt_at"), (now if status == "success" else none).alias("last_success_at"), none.alias("expires_at"),
    )


def entry_notices(entries: DataFrame) -> DataFrame:
    """Entries back as notices; missing texts are empty."""
    texts = {"title": "title", "organization": "org", "amount_raw": "amount_raw", "source": "source", "url": "url", "budget_amount": "budget_amount", "bid_bond": "bid_bond", "bid_deadline": "bid_deadline", "bid_opening_time": "bid_opening_time"}
    return entries.select("primary_key", *(F.coalesce(c, F.lit("")).alias(n) for n, c in texts.items()), "amount_value", "announcement_date", "bid_date", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def prune_cache(cache: DataFrame, now: Column) -> DataFrame:
    """I4."""
    return cache.filter(~C.is_expired_entry(F.col, now))


def read_through(df: DataFrame, cache: DataFrame, *, row: str = "ingest_ord") -> DataFrame:
    """Rows with details filled from the cache where they lack them, and detail_cache_status hit or miss. Only the
    first key found counts: if its entry is unusable, the row is a miss."""
    entry = cache.select(F.col("primary_key").alias("entry"), C.is_usable_entry(F.col).alias("usable"), F.struct(*DETAILS, "amount_value", "official_url").alias("c"))
    found = resolve(df, cache, row=row).join(entry, "entry").filter("usable").select(row, "c")
    joined = df.join(found, row, "left")
    hit = F.col("c").isNotNull()
    filled = {f: F.when(is_missing(F.col(f), MISSING_CACHED) & ~is_missing(F.col(f"c.{f}"), MISSING_CACHED), F.col(f"c.{f}")).otherwise(F.col(f)) for f in DETAILS}
    filled |= {"amount_value": F.coalesce("amount_value", "c.amount_value"), "url": F.when(F.trim(F.coalesce("c.official_url", F.lit(""))) != "", F.col("c.official_url")).otherwise(F.col("url"))}
    chain = F.col("enrichment_source") if "enrichment_source" in df.columns else F.lit("")
    done = joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns if c not in ("detail_cache_status", "enrichment_source")), F.when(hit, "hit").otherwise("miss").alias("detail_cache_status"), F.when(hit, append_source(chain, F.lit("detail_cache"))).otherwise(chain).alias("enrichment_source"))
    return done


def cache_counts(df: DataFrame) -> DataFrame:
    """A15."""
    return df.agg(F.count_if(F.col("detail_cache_status") == "hit").alias("hit"), F.count_if(F.col("detail_cache_status") == "miss").alias("miss"))


def queue_counts(before: DataFrame, after: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: entries after a batch, those that are new, and the rows that asked for detail."""
    new = after.join(before.select("primary_key"), "primary_key", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(after, "entries").join(count(new, "added")).join(count(asked, "asked"))


def enqueue_missing(queue: DataFrame, batch: DataFrame, now: Column, *, sources: list[str], most_attempts: int = 3, row: str = "ingest_ord") -> DataFrame:
    """The queue after a batch: rows that lack detail, the last of each entry; those that were tried often
    enough stay as they are; counters of known entries stay. ``queue`` has primary_key, alias_keys, source, title, org,
    url, status, attempt_counts (map), failure_reason, first_seen_at and last_attempt_at."""
    asked = _targets(batch.filter(C.should_backfill(F.col, sources)), queue, row, True)
    last = asked.groupBy("entry").agg(F.max_by(F.struct(F.left("title", F.lit(300)).alias("title"), F.left("organization", F.lit(240)).alias("org"), "source", "url", "keys", "primary_key"), row).alias("n"))
    both = queue.select(F.col("primary_key").alias("entry"), F.struct(*queue.columns).alias("o")).join(last, "entry", "full_outer")
    no_counts = F.create_map().cast("map<string,int>")
    counts = F.coalesce("o.attempt_counts", no_counts)
    tried = F.coalesce(F.try_element_at(counts, F.col("n.source")), F.lit(0)) >= most_attempts
    taken = F.col("n").isNotNull() & ~F.coalesce(tried, F.lit(False))
    pick = lambda c, new: F.when(taken, new).otherwise(F.col(f"o.{c}")).alias(c)
    out = both.filter(taken | F.col("o").isNotNull())
    return out.select(
        F.col("entry").alias("primary_key"), pick("alias_keys", F.array_sort(F.array_distinct(F.concat(F.array("entry", "n.primary_key"), F.col("n.keys"))))), pick("source", F.col("n.source")), pick("title", F.col("n.title")), pick("org", F.col("n.org")), pick("url", F.col("n.url")),
        pick("status", F.lit("pending")), counts.alias("attempt_counts"), F.coalesce("o.failure_reason", F.lit("")).alias("failure_reason"), F.coalesce("o.first_seen_at", now).alias("first_seen_at"), F.col("o.last_attempt_at").alias("last_attempt_at"),
    )


def pending(queue: DataFrame, *, limit: int = 0, sources: list[str] | None = None, most_attempts: int = 3) -> DataFrame:
    """Entries still to be tried, by key; a limit of 0 is none."""
    rows = queue.filter(F.coalesce(F.try_element_at("attempt_counts", F.col("source")), F.lit(0)) < most_attempts)
    if sources:
        rows = rows.filter(F.col("source").isin(sources))
    return rows.orderBy("primary_key").limit(limit) if limit > 0 else rows


def attempt_counters(attempts: DataFrame, *, entry: str = "entry", source: str = "source") -> DataFrame:
    """I8: (entry, attempt_counts, attempt_count) of failed attempts."""
    counted = attempts.groupBy(entry, source).agg(F.count("*").cast("int").alias("n"))
    by_entry = counted.groupBy(entry).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("attempt_counts"), F.sum("n").cast("int").alias("attempt_count"))
    return by_entry


def mark_failures(queue: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """I8: ``failures`` has entry, source, reason and at (its order): counts add up, the last reason stays (240)."""
    counts = attempt_counters(failures).join(failures.groupBy("entry").agg(F.left(F.max_by("reason", "at"), F.lit(240)).alias("reason")), "entry")
    joined = queue.join(counts.withColumnRenamed("attempt_counts", "more"), queue["primary_key"] == counts["entry"], "left")
    failed = F.col("more").isNotNull()
    none = F.create_map().cast("map<string,int>")
    added = F.map_zip_with(F.coalesce("attempt_counts", none), F.coalesce("more", none), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    changed = {"attempt_counts": added, "status": F.when(failed, "failed").otherwise(F.col("status")), "failure_reason": F.when(failed, F.col("reason")).otherwise(F.col("failure_reason")), "last_attempt_at": F.when(failed, now).otherwise(F.col("last_attempt_at"))}
    return joined.select(*((changed[c].alias(c)) if c in changed else queue[c] for c in queue.columns))


def mark_successes(cache: DataFrame, queue: DataFrame, done: DataFrame, now: Column, ttl_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(cache, queue) after successes. ``done`` has the cache's columns but expires_at, and ``at`` (its order)."""
    last = done.groupBy("primary_key").agg(F.max_by(F.struct(*(c for c in done.columns if c not in ("primary_key", "at"))), "at").alias("n"))
    new = last.select("primary_key", F.col("n.*")).withColumn("expires_at", now + F.make_dt_interval(F.lit(max(ttl_days, 1))))
    kept = cache.join(new.select("primary_key"), "primary_key", "left_anti")
    reached = new.select(F.explode(F.array_union(F.array("primary_key"), F.col("alias_keys"))).alias("key")).join(alias_index(queue), "key").select(F.col("entry").alias("primary_key")).distinct()
    return kept.unionByName(new.select(*cache.columns)), queue.join(reached, "primary_key", "left_anti")


def route_attempts(pending_rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Pending entries with the outcome of their attempt: success if any detail came, failure, or skipped
    where nothing was tried. ``attempts`` has primary_key, the details, amount_value and error."""
    any_detail = F.col("amount_value").isNotNull()
    for f in DETAILS:
        any_detail = any_detail | ~is_missing(F.col(f), MISSING_CACHED)
    tried = pending_rows.join(attempts, "primary_key", "left")
    error = F.nullif(F.coalesce("error", F.lit("")), F.lit(""))
    outcome = F.when(F.col("error").isNull() & ~any_detail & F.col("amount_value").isNull() & F.col("budget_amount").isNull(), "skipped").when(error.isNotNull() | ~any_detail, "failure").otherwise("success")
    return tried.withColumn("outcome", outcome)
