"""The plans: daily monitor, backfill round, log report (entries A, B and C)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import keys as K
from noticeworks.functions.text import normalize_text
from noticeworks.operators import dedup, gate, link, logs, standardize, state
from noticeworks.rules import DEFAULT, RulePack
from noticeworks.tables import store

BIDS = (
    "ingest_ord long, title string, organization string, bid_date date, announcement_date date, amount_raw string, amount_value double, source string, url string, summary string, category string, metadata map<string,string>, candidate_only boolean, category_hint string, "
    "budget_amount string, bid_bond string, bid_deadline string, bid_opening_time string, ai_priority string, backup_source string, uid string"
)
TEXTS = ("title", "organization", "amount_raw", "source", "url", "summary", "category", "budget_amount", "bid_bond", "bid_deadline", "bid_opening_time", "ai_priority", "uid")


def complete(df: DataFrame) -> DataFrame:
    """Rows with all columns of a notice: missing columns are null, missing texts empty."""
    schema = dict(c.strip().split(" ", 1) for c in BIDS.replace("map<string,string>", "map<string;string>").split(", "))
    schema = {c: t.replace(";", ",") for c, t in schema.items()}
    have = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in schema.items()}
    return df.select(*((F.coalesce(v, F.lit("")) if c in TEXTS else F.coalesce(v, F.create_map().cast("map<string,string>")) if c == "metadata" else v).alias(c) for c, v in have.items()))


def _linkable(df: DataFrame, name: str) -> DataFrame:
    """Inputs of hint matching; the due date comes first there."""
    return df.select(F.col("ingest_ord").alias(name), K.tender_ids(F.col("title"), F.col("url"), F.col("metadata")).alias("ids"), normalize_text(F.col("organization")).alias("n_org"), normalize_text(F.col("title")).alias("n_title"), F.coalesce("bid_date", "announcement_date").alias("day"))


def apply_hints(bids: DataFrame, *, propagate_hint: bool = False, target: str = "gov_pcc", source: str = "taiwanbuying") -> tuple[DataFrame, DataFrame]:
    """J4 over complete notices: (formal notices with the match columns, matches). Candidates give hints, never rows."""
    candidates = bids.filter((F.col("source") == source) & (F.col("category_hint") == "computer_edu") & F.coalesce("candidate_only", F.lit(False)))
    targets = bids.filter(F.col("source") == target)
    matches = link.match_hints(_linkable(candidates, "cand"), _linkable(targets, "target"))
    info = candidates.select(F.col("ingest_ord").alias("cand"), "url", "category", "bid_date")
    marked = link.annotate_targets(targets.withColumn("target", F.col("ingest_ord")).drop("category_hint"), matches, info, propagate_hint=propagate_hint).drop("target")
    others = bids.filter(~F.col("source").isin(target, source)).drop("category_hint")
    return marked.unionByName(others, allowMissingColumns=True), matches


@dataclass
class MonitorResult:
    new: DataFrame
    funnel: DataFrame
    state: DataFrame
    queue: DataFrame | None


def monitor(
    bids: DataFrame,
    notified: DataFrame | Callable[[DataFrame], DataFrame],
    now: Column,
    *,
    pack: RulePack = DEFAULT,
    cache: DataFrame | None = None,
    queue: DataFrame | None = None,
    recent_days: int = 3,
    retention_days: int = 90,
    backfill_sources: tuple[str, ...] = ("gov_pcc", "g0v"),
    propagate_hint: bool = False,
) -> MonitorResult:
    """Entry A without its deliveries: hints, gate, duplicates, cache, expiry, state anti-join, ranking, and the state
    and queue to write once the digest was sent. ``notified`` is the state, or gives the entries that rows can meet."""
    bids = complete(bids)
    formal, _ = apply_hints(bids, propagate_hint=propagate_hint)
    gated = gate.filter_notices(formal.withColumn("metadata", F.when(F.col("category_hint").isNotNull(), F.map_concat("metadata", F.create_map(F.lit("category_hint"), F.col("category_hint")))).otherwise(F.col("metadata"))) if propagate_hint else formal, pack)
    gated = store(gated, "monitor-gated").df
    unique = store(dedup.deduplicate(standardize.standardize_keys(gated)), "monitor").df
    unique = standardize.standardize_keys(unique.drop("keys", "primary_key", "exact_key", "n_title", "n_org", "amount_key", "record_date"))
    if cache is not None:
        unique = state.read_through(unique, state.prune_cache(cache, now))
    active = gate.drop_candidates(gate.drop_expired(unique, now))
    held = state.prune_state(notified(active) if callable(notified) else notified, now, retention_days)
    new = store(gate.with_reason(state.drop_notified(active, held), F.to_date(now), recent_days), "monitor-new").df
    after = state.mark_notified(held, new, now)
    later = None
    if queue is not None:
        asked = new.withColumn("lookup_url", F.col("url"))
        later = state.enqueue_missing(queue, asked, now, sources=list(backfill_sources))
    return MonitorResult(gate.rank_notifications(new), gate.run_funnel(crawled=bids, filtered=gated, deduped=unique, new=new), after, later)


def backfill(cache: DataFrame, queue: DataFrame, attempts: DataFrame, now: Column, *, limit: int = 0, sources: list[str] | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entry B: (cache, queue, counts by source and outcome). ``attempts`` has the outcome of each pending entry's
    attempt (see route_attempts); ``dry_run`` only counts."""
    tried = state.route_attempts(state.pending(queue, limit=limit, sources=sources), attempts)
    counts = tried.groupBy("source", "outcome").agg(F.count("*").alias("n"))
    if dry_run:
        return cache, queue, counts
    good = tried.filter("outcome = 'success'").withColumns({"status": F.lit("success"), "at": F.lit(0)})
    missing = [c for c in cache.columns if c not in good.columns and c != "expires_at"]
    done = good.withColumns({c: F.lit(None).cast(dict(cache.dtypes)[c]) for c in missing}).select(*(c for c in cache.columns if c != "expires_at"), "at")
    cache, rest = state.mark_successes(cache, queue, done, now)
    bad = tried.filter("outcome = 'failure'").select(F.col("primary_key").alias("entry"), "source", F.coalesce(F.nullif("error", F.lit("")), F.lit("no_detail")).alias("reason"), F.lit(0).alias("at"))
    return cache, state.mark_failures(rest, bad, now), counts


def log_report(lines: DataFrame, days: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entry C: (days, streak of days without recall)."""
    kept = logs.last_days(logs.daily_rollup(logs.scan_log(lines)), days)
    observed = (F.col("applied_runs") + F.col("recall_runs")) > 0
    return kept, logs.zero_streak(kept, observed=observed, zero=(F.col("candidates_total") > 0) & (F.col("recalled_total") == 0))
