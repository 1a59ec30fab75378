"""Dates and deadlines in free text (F7-F9, F22, F23, F26, F35). Years below 1911 count from 1912."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MISSING_DEADLINE, bind, strip, text

# Date and time forms, and the years that a notice can have.
ROC_DATE = r"(\d{2,3})\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})"
DEADLINE_DATE = r"(\d{2,4})\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})"
TIME = r"(\d{1,2})\s*[:：]\s*(\d{1,2})"
FIRST_YEAR, LAST_YEAR, ROC_OFFSET = 2000, 2100, 1911
#: Numeric forms tried where no short-year form is found.
OTHER_FORMS = ["yyyy.M.d", "M/d/yyyy"]
# Month names, in English, and times of day with their zones.
MONTHS = ["jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?"]
CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[ap]m\b)?(?:\s*(?:z|utc|gmt)\b)?(?:\s*[+-]\d{2}:?\d{2}\b)?|\b\d{1,2}\s*[ap]m\b"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def make_day(year: Column, month: Column, day: Column) -> Column:
    """Null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _notice_day(year: Column, month: Column, day: Column) -> Column:
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), make_day(year, month, day))


def _roc(year: Column) -> Column:
    return F.when(year < ROC_OFFSET, year + ROC_OFFSET).otherwise(year)


def _numbers(hit: Column) -> Column:
    return F.transform(F.split(hit, r"\D+"), _int)


def _named_month(clean: Column) -> Column:
    """A day told with a month's name: of the three parts month, day and year in any order, whatever words and times of
    day stand between them. A number above 31 is the year; of two that are not, the day comes first unless the month comes
    last. Years of two digits lie within 50 years of now. Texts with fewer or more numbers have no day."""
    words = [rf"\b{m}\b" for m in MONTHS]
    plain = F.regexp_replace(F.lower(clean), CLOCK, " ")
    parts = F.regexp_extract_all(plain, F.lit(rf"({'|'.join(words)}|\d+)"), F.lit(1))
    is_month = lambda x: ~x.rlike(r"^\d")
    now = F.year(F.current_date())

    def whole(year: Column) -> Column:
        near = F.when(year + 2000 >= now + 50, year + 1900).otherwise(year + 2000)
        return F.when(year < 100, near).otherwise(year)

    def day(p: Column) -> Column:
        name, numbers = F.get(F.filter(p, is_month), 0), F.transform(F.filter(p, lambda x: ~is_month(x)), _int)
        month = F.coalesce(*(F.when(name.rlike(f"^{m}$"), i) for i, m in enumerate(MONTHS, 1)))
        a, b = F.get(numbers, 0), F.get(numbers, 1)
        last = is_month(F.get(p, 2))
        year_first = F.when(last, b <= 31).otherwise(a > 31)
        return F.when((F.size(p) == 3) & (F.size(numbers) == 2), _notice_day(whole(F.when(year_first, a).otherwise(b)), month, F.when(year_first, b).otherwise(a)))

    return bind(parts, day)


def parse_day(c: Column) -> Column:
    """F7, on text in NFKC form. Where a short-year form is found, its result stands, even if null."""

    def from_digits(digits: Column) -> Column:
        n, century = F.length(digits), digits.startswith("19") | digits.startswith("20")
        at = lambda i, k: _int(F.substring(digits, i, k))
        return (
            F.when((n == 8) & century, _notice_day(at(1, 4), at(5, 2), at(7, 2)))
            .when(n == 7, _notice_day(at(1, 3) + ROC_OFFSET, at(4, 2), at(6, 2)))
            .when((n == 6) & ~century, _notice_day(at(1, 2) + ROC_OFFSET, at(3, 2), at(5, 2)))
        )

    def other(clean: Column) -> Column:
        numeric = bind(F.coalesce(*(F.try_to_date(clean, f) for f in OTHER_FORMS)), lambda d: F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d))
        return F.when(F.lower(clean).rlike("|".join(rf"\b{m}\b" for m in MONTHS)), _named_month(clean)).otherwise(numeric)

    def short(hit: Column, clean: Column) -> Column:
        return F.when(hit != "", bind(_numbers(hit), lambda p: _notice_day(_roc(F.get(p, 0)), F.get(p, 1), F.get(p, 2)))).otherwise(other(clean))

    return bind(strip(c), lambda clean: F.coalesce(bind(F.regexp_replace(clean, r"\D", ""), from_digits), bind(F.regexp_extract(clean, ROC_DATE, 0), lambda hit: short(hit, clean))))


def parse_deadline(c: Column) -> Column:
    """F8: struct(d date, minutes int); minutes are null without a valid time; null without a valid date."""

    def minutes(rest: Column) -> Column:
        at = _numbers(F.regexp_extract(rest, TIME, 0))
        return bind(at, lambda t: F.when((F.get(t, 0) < 24) & (F.get(t, 1) < 60), 60 * F.get(t, 0) + F.get(t, 1)))

    def timed(hit: Column, clean: Column) -> Column:
        # The text that is found first stands where it occurs first.
        rest = F.substr(clean, F.position(hit, clean) + F.length(hit))
        day = bind(_numbers(hit), lambda p: make_day(_roc(F.get(p, 0)), F.get(p, 1), F.get(p, 2)))
        return bind(day, lambda d: F.when(d.isNotNull(), F.struct(d.alias("d"), minutes(rest).alias("minutes"))))

    found = lambda clean: bind(F.regexp_extract(clean, DEADLINE_DATE, 0), lambda hit: F.when((hit != "") & ~F.lower(clean).isin(MISSING_DEADLINE), timed(hit, clean)))
    return bind(strip(c), found)


def deadline_at(parsed: Column) -> Column:
    """The deadline as a timestamp without zone; null for a day alone."""
    return F.when(parsed["minutes"].isNotNull(), F.timestamp_seconds(F.unix_date(parsed["d"]).cast("long") * 86400 + parsed["minutes"] * 60))


def is_expired(c: Column, now: Column) -> Column:
    """a day alone is over the day after; text without a date never is."""
    over = lambda p: F.when(p["minutes"].isNull(), p["d"] < F.to_date(now)).otherwise(deadline_at(p) < now)
    return F.coalesce(bind(parse_deadline(c), over), F.lit(False))


def deadline_order(c: Column) -> Column:
    """sorts by deadline; what cannot be read sorts last."""
    order = lambda p: F.struct(F.coalesce(p["d"], F.lit("9999-12-31").cast("date")).alias("d"), F.coalesce(p["minutes"], F.when(p.isNull(), 1439).otherwise(0)).alias("minutes"))
    return bind(parse_deadline(c), order)


def show_deadline(c: Column) -> Column:
    """``2026/04/29 17:00``, or without the time; other text as it is."""

    def show(p: Column) -> Column:
        day = F.date_format(p["d"], "yyyy/MM/dd")
        timed = F.format_string("%s %02d:%02d", day, F.floor(p["minutes"] / 60).cast("int"), p["minutes"] % 60)
        return F.when(p.isNull(), text(c)).when(p["minutes"].isNull(), day).otherwise(timed)

    return bind(parse_deadline(c), show)


def effective_day(announced: Column, due: Column) -> Column:
    """F26."""
    return F.coalesce(announced, due)


def parse_instant(c: Column) -> Column:
    """ISO text as a UTC timestamp; text without a zone is UTC (with the session's zone at UTC)."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
