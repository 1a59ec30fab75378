"""Amounts of money in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, is_no, strip, text

# What speaks for and against an amount.
MONEY = r"(?i)預算金額|採購金額|決標金額|底價|新[臺台]幣|[臺台]幣|NT\$?|NTD"
EXPLICIT_MONEY, LOOSE_MONEY = MONEY + r"|\d+\s*元", MONEY + "|金額|元"
NO_AMOUNT = ["手續費", "電子領標", "領標費", "下載費", "系統使用費", "廠商家數", "件數", "電話", "傳真", "統一編號", "郵遞區號", "履約期限"]
NO_AMOUNT_WITHOUT_MONEY = ["日期", "時間", "截止", "開標", "民國", "年", "月", "日"]
NUMBER = r"\d+(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
LEAST_PLAIN = 10_000


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def is_no_amount(c: Column) -> Column:
    """F4."""
    dated = c.rlike("|".join(NO_AMOUNT_WITHOUT_MONEY)) & ~c.rlike(EXPLICIT_MONEY)
    return c.rlike("[%％]") | ~c.rlike(r"\d") | c.rlike("|".join(NO_AMOUNT)) | dated


def unit_amount(c: Column) -> Column:
    """the sum of 億, 萬 and 千元 parts; null if there is none or it is zero."""
    unit = r"\d+(?:,\d{3})*(?:\.\d+)?(?:億|萬|千元)"
    compact = F.replace(F.regexp_replace(c, r"\s+|新臺幣|新台幣|臺幣|台幣|NT\$|NTD", ""), F.lit("元整"), F.lit("元"))
    worth = lambda p: _number(F.rtrim(p, F.lit("億萬千元"))) * F.when(p.endswith("億"), 1e8).when(p.endswith("萬"), 1e4).otherwise(1e3)
    total = F.aggregate(F.regexp_extract_all(compact, F.lit(unit), 0), F.lit(0.0), lambda total, p: total + worth(p))
    return F.when(c.rlike("[億萬千]"), bind(total, lambda x: F.nullif(x, F.lit(0.0))))


def plain_amount(c: Column) -> Column:
    """the greatest number; without words of money only a single one of 10,000 or more."""
    values = F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 0), _number)
    return bind(values, lambda v: F.when(c.rlike(LOOSE_MONEY), F.array_max(v)).when((F.size(v) == 1) & (F.get(v, 0) >= LEAST_PLAIN), F.get(v, 0)))


def parse_amount(c: Column) -> Column:
    """F3, on text in NFKC form."""
    return bind(strip(c), lambda clean: F.when(~is_no_amount(clean), F.coalesce(unit_amount(clean), plain_amount(clean))))


def amount_key(value: Column, normal_raw: Column) -> Column:
    """the amount rounded half to even, else the normalised raw text."""
    return F.coalesce(F.bround(value, 0).cast("bigint").cast("string"), normal_raw)


def format_amount(value: Column, raw: Column | None = None) -> Column:
    """``NT$ 1,234`` of the truncated amount, else the raw text."""
    shown = F.concat(F.lit("NT$ "), F.format_number(value.cast("bigint"), 0))
    return F.coalesce(shown, text(raw) if raw is not None else F.lit(""))


def _bond_part(c: Column) -> Column:
    after = F.regexp_replace(c, r"(?s)^.*?押標金額度[：:\s]*", "")
    return F.regexp_replace(after, r"(?s)(?:廠商線上繳納押標金)?手續費[：:\s]*.*$", "")


def _percent(c: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(c, r"百分之\s*([\d,.]+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"([\d,.]+)\s*[%％]", 1), F.lit("")))
    return F.concat(found, F.lit("%"))


def _stated(c: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"(?:新臺?幣|NT\$?)\s*([\d,]+)\s*元?", r"([\d,]+)\s*元(?:整)?")))


def bond_value(c: Column) -> Column:
    """F16: 免繳, a percentage, ``NT$ n 元`` or 需繳納, from a page's text without the payment fee."""
    clean = strip(c)
    part, amount = _bond_part(clean), parse_amount(_bond_part(clean))
    money = lambda x: F.concat(F.lit("NT$ "), x, F.lit(" 元"))
    bare = F.when(clean.contains("押標金額度"), F.nullif(F.regexp_extract(part, r"([\d,]+)", 1), F.lit("")))
    return F.when(F.lower(clean).rlike("否|免|不需|無需|不繳|waived"), "免繳").otherwise(
        F.coalesce(_percent(part), money(F.format_number(amount.cast("bigint"), 0)), money(_stated(part)), money(bare), F.lit("需繳納"))
    )


def bond_text(c: Column, *, keep_plain: bool = False) -> Column:
    """the API's variant: bare numbers, '' if nothing is said."""
    clean = strip(c)
    part = strip(_bond_part(clean))
    large = F.when(part.rlike("[萬億]|千元"), F.format_number(parse_amount(part).cast("bigint"), 0))
    plain = F.when((part != "") & ~clean.contains("手續費"), part) if keep_plain else F.lit(None)
    return F.when(clean == "", "").when(is_no(clean), "免繳").otherwise(F.coalesce(_percent(part), large, _stated(part), plain, F.when(clean.startswith("是"), "需繳納"), F.lit("")))


def metadata_number(metadata: Column, *keys: str) -> Column:
    """the first usable of synonymous keys, by its digits."""
    return F.coalesce(*(F.regexp_replace(metadata[k], r"[^\d.]", "").try_cast("double") for k in keys))


def metadata_text(metadata: Column, *keys: str) -> Column:
    return strip(F.coalesce(*(metadata[k] for k in keys), F.lit("")))


def content_uid(title: Column, org: Column, day: Column, key: Column) -> Column:
    """F11, from normalised texts and an amount key."""
    return F.sha2(F.concat_ws("|", title, org, F.coalesce(day.cast("string"), F.lit("")), key).cast("binary"), 256)


