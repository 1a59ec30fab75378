"""Predicates and classes of notices and pages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.rules import DEFAULT, RulePack

from .amounts import metadata_number, metadata_text
from .dates import parse_deadline
from .text import MISSING_CACHED, MISSING_DETAIL, any_of, gate_text, is_missing, missing_amount, strip, text

# Procurement terms and thresholds, outcome rules, types and states.
SERVICE, GOODS, OTHER = "勞務", "財物", "其他"
SERVICE_TERMS = ["勞務", "顧問", "委託", "維運", "服務", "系統整合", "資訊服務", "技術服務"]
GOODS_TERMS = ["財物", "軟體", "硬體", "設備", "儀器", "採購", "授權", "工作站", "伺服器", "電腦"]
STRATEGIC = ["a", "a級", "a 級", "strategy", "strategic", "策略", "策略客戶"]
HIGH_AMOUNT, GIGANTIC_SERVICE, GIGANTIC_GOODS = 10_000_000.0, 20_000_000.0, 100_000_000.0
OUTCOMES = [
    ("captcha", r"驗證碼檢核|請輸入驗證碼|captcha|recaptcha|hcaptcha|cf-turnstile|請完成驗證"),
    ("cloudflare_challenge", r"cf-browser-verification|challenge-platform|Just a moment|Checking your browser|_cf_chl_opt|managed_checking_msg|cf-wrapper|__cf_chl_jschl_tk__|__cf_chl_"),
    ("access_denied", r"access\s*denied|存取被拒|拒絕存取|403\s*forbidden|您無權限存取"),
    ("rate_limited", r"too\s*many\s*requests|請稍後再試|rate\s*limit|請求過於頻繁"),
    ("soft_block", r"unusual\s*traffic|異常流量|suspicious\s*activity|請重新整理"),
]
PUBLIC_TENDER = "公開招標"


def is_educational(org: Column, pack: RulePack = DEFAULT) -> Column:
    """Strong exclusions, then weak ones unless whitelisted, then inclusions; case as it stands."""
    raw = text(org)
    return F.when(any_of(raw, pack.org_exclude_strong), False).when(any_of(raw, pack.org_exclude_weak) & ~any_of(raw, pack.org_whitelist), False).otherwise(any_of(raw, pack.org_include))


def has_project_context(title: Column, summary: Column, category: Column, pack: RulePack = DEFAULT) -> Column:
    """P3."""
    return any_of(gate_text(title, summary, category), [w.lower() for w in pack.project_context])


def is_excluded(title: Column, summary: Column, category: Column, pack: RulePack = DEFAULT) -> Column:
    """P4."""
    return any_of(gate_text(title, summary, category), [w.lower() for w in pack.exclude])


def has_theme(title: Column, summary: Column, category: Column, pack: RulePack = DEFAULT) -> Column:
    """Not excluded, and a direct word, or a conditional term together with its context."""
    words = gate_text(title, summary, category)
    direct = [w.lower() for w in (*pack.strict, *pack.stable, *pack.broad) if w not in pack.support_only]
    conditional = [words.contains(term) & any_of(words, context) for term, context in pack.conditional]
    return ~is_excluded(title, summary, category, pack) & reduce(or_, conditional, any_of(words, direct))


def is_fallback_title(title: Column, org: Column, pack: RulePack = DEFAULT) -> Column:
    """P8."""
    return F.lower(strip(title)).isin(pack.fallback_titles) & any_of(text(org), pack.fallback_orgs)


def passes_gate(title: Column, org: Column, summary: Column, category: Column, hint: Column, pack: RulePack = DEFAULT) -> Column:
    """P9."""
    place = is_educational(org, pack) | has_project_context(title, summary, category, pack)
    topic = F.coalesce(hint == pack.hint, F.lit(False)) | has_theme(title, summary, category, pack) | is_fallback_title(title, org, pack)
    return place & ~is_excluded(title, summary, category, pack) & topic


def unit_type(org: Column, pack: RulePack = DEFAULT) -> Column:
    """The first class of which a word stands in the name."""
    out = F
    for name, words in pack.unit_types:
        out = out.when(any_of(text(org), words), name)
    return out.otherwise(pack.other_unit) if out is not F else F.lit(pack.other_unit)


def theme_tags(title: Column, summary: Column, category: Column, pack: RulePack = DEFAULT, hint: Column | None = None) -> Column:
    """Tags in the pack's order; the hint's tag is added at the end."""
    words = gate_text(title, summary, category)
    tags = [F.when(any_of(words, [w.lower() for w in ws]), F.lit(tag)) for tag, ws in pack.tags.items()]
    if hint is not None:
        tags.append(F.when(hint == pack.hint, F.lit(pack.hint_tag)))
    return F.array_distinct(F.array_compact(F.array(*tags))) if tags else F.array().cast("array<string>")


def within_days(left: Column, right: Column, days: int) -> Column:
    """P16."""
    return F.coalesce(F.abs(F.datediff(left, right)) <= max(days, 0), F.lit(False))


def amounts_close(a: Column, b: Column) -> Column:
    """P17."""
    gap = F.abs(a - b)
    return a.isNull() | b.isNull() | (gap <= 5000) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= 0.05)


def same_day(a: Column, b: Column) -> Column:
    """P18."""
    return a.eqNullSafe(b)


def is_public_tender(kind: Column) -> Column:
    """P19."""
    return text(kind).contains(PUBLIC_TENDER)


DETAIL_FIELDS = ("budget_amount", "bid_bond", "bid_deadline", "bid_opening_time")


def needs_detail(c, values: list[str] = MISSING_DETAIL) -> Column:
    """P12. ``c`` gives a column by name."""
    return reduce(or_, (is_missing(c(f), values) for f in DETAIL_FIELDS), missing_amount(c("amount_value"), c("budget_amount")))


def should_backfill(c, sources: list[str]) -> Column:
    """The source is allowed, the detail can be found, and something is missing."""
    locator = (c("source") != "g0v") | (F.coalesce(c("lookup_url"), F.lit("")) != "")
    return c("source").isin(sources) & (strip(c("url")) != "") & locator & needs_detail(c, MISSING_CACHED)


def is_usable_entry(c) -> Column:
    """P14."""
    return (c("status") == "success") & (c("amount_value").isNotNull() | reduce(or_, (~is_missing(c(f), MISSING_CACHED) for f in DETAIL_FIELDS)))


def is_expired_entry(c, now: Column) -> Column:
    """P15."""
    return F.coalesce(c("expires_at") < now, F.lit(False)) | F.coalesce(parse_deadline(c("bid_deadline"))["d"] < F.date_sub(F.to_date(now), 1), F.lit(False))


def notification_reason(day: Column, today: Column, recent_days: int = 3) -> Column:
    """C9."""
    return F.when(day.isNull(), "catch_up_unknown_date").when(day >= F.date_sub(today, max(recent_days, 1)), "new_recent").otherwise("catch_up_unnotified")


def procurement_category(category: Column, title: Column, summary: Column, stated: Column | None = None) -> Column:
    """Service terms come before goods terms."""
    words = F.concat_ws(" ", *(F.nullif(text(c), F.lit("")) for c in (category, title, summary, *([stated] if stated is not None else []))))
    return F.when(any_of(words, SERVICE_TERMS), SERVICE).when(any_of(words, GOODS_TERMS), GOODS).otherwise(OTHER)


def high_amount(amount: Column, kind: Column, title: Column, summary: Column, metadata: Column, fallback: float | None = None) -> Column:
    """C11: struct of the decision, the thresholds and the reasons, in the order of the rules."""
    high = F.when(kind.isin(SERVICE, GOODS), HIGH_AMOUNT).otherwise(fallback or HIGH_AMOUNT)
    gigantic = F.when(kind == SERVICE, GIGANTIC_SERVICE).otherwise(GIGANTIC_GOODS)
    is_gigantic = F.coalesce(amount >= gigantic, F.lit(False))
    tier = F.lower(metadata_text(metadata, "customer_tier", "client_tier", "account_tier", "customer_grade"))
    long = (
        F.coalesce(metadata_number(metadata, "contract_years", "term_years", "contract_duration_years") >= 3, F.lit(False))
        | F.coalesce(metadata_number(metadata, "contract_months", "term_months", "contract_duration_months") >= 36, F.lit(False))
        | F.concat_ws(" ", text(title), text(summary)).rlike(r"(?:3|三)\s*年(?:期|以上)?|36\s*個?月")
    )
    reasons = F.array_compact(
        F.array(
            F.when(amount >= high, F.concat(kind, F.lit("金額達高金額門檻"))),
            F.when(amount >= metadata_number(metadata, "won_p80_amount", "p80_amount", "past_12m_won_p80"), "金額達近12個月得標案件P80"),
            F.when((amount >= high * 0.5) & tier.isin(STRATEGIC), "A級/策略客戶且達標準門檻50%"),
            F.when(long, "3年以上長約"),
            F.when(is_gigantic, F.concat(kind, F.lit("金額達巨額門檻"))),
        )
    )
    return F.struct(
        (F.size(reasons) > 0).alias("is_high_amount"), is_gigantic.alias("is_gigantic_amount"), amount.alias("amount"), kind.alias("procurement_category"), high.alias("high_threshold"), gigantic.alias("gigantic_threshold"), reasons.alias("reasons")
    )


def page_outcome(html: Column, *, status: Column | None = None, found: Column | None = None, timed_out: Column | None = None) -> Column:
    """Timeout, status, content rules by priority, missing content, success."""
    out = F.when(timed_out if timed_out is not None else F.lit(False), "timeout")
    if status is not None:
        out = out.when(status == 403, "hard_block").when(status == 429, "rate_limited").when(status >= 500, "unknown_failure")
    for name, pattern in OUTCOMES:
        out = out.when(text(html).rlike(f"(?i){pattern}"), name)
    return out.when(~(found if found is not None else F.lit(True)), "empty_content").otherwise("success")


REPLY_SCHEMA = "edu_score int, it_score int, priority string, ai_summary string, edu_reason string, it_reason string, suggested_tags array<string>, confidence double, is_relevant boolean, reason string"


def parse_reply(reply: Column, *, validation: bool = False) -> Column:
    """C14: struct of a model's JSON reply without code fences; ``error`` is set where it is no JSON object. The
    validation form has one confidence, which gives both scores."""
    body = strip(F.regexp_replace(text(reply), r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    row = F.from_json(body, REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    bad = ~body.rlike(r"(?s)^\{.*\}$") | F.try_parse_json(body).isNull()
    if validation:
        score = F.coalesce((row["confidence"] * 10).cast("int"), F.lit(0))
        edu = it = score
        edu_reason, it_reason = F.coalesce(row["reason"], F.lit("")), F.lit("")
    else:
        edu, it = (F.coalesce(row[c], F.lit(0)) for c in ("edu_score", "it_score"))
        edu_reason, it_reason = (F.coalesce(row[c], F.lit("")) for c in ("edu_reason", "it_reason"))
    return F.struct(
        F.when(bad, 0).otherwise(edu).alias("edu_score"), F.when(bad, 0).otherwise(it).alias("it_score"), F.when(bad, "").otherwise(F.coalesce(row["priority"], F.lit("low"))).alias("priority"),
        F.when(bad, "").otherwise(F.coalesce(row["ai_summary"], F.lit(""))).alias("summary"), F.when(bad, "").otherwise(F.concat_ws(" | ", edu_reason, it_reason)).alias("reason"), row["suggested_tags"].alias("suggested_tags"), F.when(bad, "bad_json").alias("error"),
    )


def prompt(template: str, **fields: Column) -> Column:
    """A prompt text; ``{name}`` in the template stands for a field, and an empty field for 未提供."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("未提供")))
    return out
