"""Text columns: normalisation, missing values, URLs, log fields."""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noticeworks.rules import RulePack

# What counts as missing, which differs by place.
MISSING_DETAIL = ["", "none", "null", "無", "無提供", "n/a", "詳見連結"]
MISSING_CACHED = ["", "none", "null", "無", "無提供", "n/a", "詳見連結", "已公開（金額見詳細頁）"]
MISSING_API = ["", "none", "null", "無", "無提供", "n/a"]
MISSING_DEADLINE = ["", "無", "無提供", "未提供", "詳見連結", "none", "null", "n/a"]
UNPUBLISHED = "未公開"
API_BASE, WEB_BASE, OFFICIAL_HOST = "https://pcc-api.openfun.app/api", "https://pcc-api.openfun.app", "web.pcc.gov.tw"

SPACE = r"(?U)[\s\x1c-\x1f]"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark lacks; ASCII texts pass as they are."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(c), f), 0)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), rf"^{SPACE}+|{SPACE}+$".replace("|(?U)", "|"), "")


def normalize_text(c: Column, *, compose: bool = True) -> Column:
    """NFKC, 臺 as 台, no punctuation, symbols or white space, lower case. ``compose`` false leaves out NFKC,
    for texts known to be in that form, and then runs without Python."""
    out = F.translate(text(nfkc(c) if compose else c), "臺", "台")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"[\p{P}\p{S}]", ""), rf"{SPACE}+", ""))


def first_text(*columns: Column) -> Column:
    """the first that is not empty once stripped; '' if none."""
    return F.coalesce(*(F.nullif(F.when(c.isNotNull(), strip(c)), F.lit("")) for c in columns), F.lit(""))


def query_value(url: Column, name: str) -> Column:
    """a query parameter's first non-empty value, decoded and stripped; '' if none."""
    raw = F.regexp_extract(text(url), rf"^[^?#]*\?(?:[^#]*&)??{name}=([^&#]+)", 1)
    return strip(F.coalesce(F.try_url_decode(raw), raw))


def hash_key(prefix: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha2(payload.cast("binary"), 256))


def url_key(url: Column) -> Column:
    """null for an empty URL."""
    return F.when(strip(url) != "", hash_key("url", F.lower(strip(url))))


def resolve_url(base: str, link: Column) -> Column:
    """absolute links stay, rooted ones get the base's host, others its folder."""
    root = "/".join(base.split("/")[:3])
    folder = base.rsplit("/", 1)[0] + "/" if base.count("/") > 2 else base + "/"
    return F.when(text(link) == "", "").when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(F.lit(root), link)).otherwise(F.concat(F.lit(folder), link))


def is_missing(c: Column, values: list[str] = MISSING_DETAIL) -> Column:
    """F18, with the set of the place."""
    return F.lower(strip(c)).isin(values)


def is_no(c: Column) -> Column:
    """F19."""
    low = F.lower(strip(c))
    return low.startswith("否") | low.isin("no", "false", "0")


def missing_amount(amount: Column, budget: Column) -> Column:
    """F20."""
    return amount.isNull() & (strip(budget) != UNPUBLISHED)


def sanitize(c: Column, limit: int = 0) -> Column:
    """one line, cut to ``limit``, without brackets that would end a log literal."""
    out = strip(F.regexp_replace(text(c), rf"{SPACE}+", " "))
    return F.translate(F.left(out, F.lit(limit)) if limit > 0 else out, "[]{}", "()()")


def append_source(chain: Column, source: Column) -> Column:
    """a '+' chain without repeats."""
    parts = F.filter(F.concat(F.split(text(chain), r"\+"), F.array(text(source))), lambda x: x != "")
    return F.array_join(F.array_distinct(parts), "+")


def display_sources(chain: Column, names: dict[str, str]) -> Column:
    """the chain with display names; an unknown part stays."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    parts = F.filter(F.split(text(chain), r"\+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x)) if known is not None else parts, " + ")


def log_number(extra: Column, key: str) -> Column:
    """``key=digits`` as a number; null if it is not there."""
    return F.regexp_extract(extra, rf"\b{key}=(\d+)\b", 1).try_cast("int")


def _balanced(said: str, key: str, *, anywhere: bool) -> str | None:
    """The text from the bracket after ``key=`` to the one that closes it; other kinds of brackets do not count."""
    _, found, rest = said.partition(f"{key}=")
    begin = rest.find("{") if anywhere else len(rest) - len(rest.lstrip())
    if not found or begin < 0 or rest[begin : begin + 1] not in ("{", "["):
        return None
    opening, depth = rest[begin], 0
    for bracket in re.finditer(r"[{}]" if opening == "{" else r"[\[\]]", rest[begin:]):
        depth += 1 if bracket[0] == opening else -1
        if not depth:
            return rest[begin : begin + bracket.end()]
    return None


def log_literal(extra: Column, key: str, *, anywhere: bool = False) -> Column:
    """the dictionary or list after ``key=`` as JSON text: nested, with quotes of either kind inside. It must begin
    there; with ``anywhere`` the first dictionary after ``key=`` counts. What is not a plain literal gives null."""

    @F.pandas_udf(StringType())
    def read(texts: pd.Series) -> pd.Series:
        def one(said: str | None) -> str | None:
            raw = _balanced(said, key, anywhere=anywhere) if said and f"{key}=" in said else None
            try:
                return None if raw is None else json.dumps(ast.literal_eval(raw), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one)

    return read(extra)


def platform(user_agent: Column) -> Column:
    """F30."""
    ua = F.lower(text(user_agent))
    return F.when(ua.rlike("windows|win32"), "Windows").when(ua.rlike("macintosh|macintel"), "Mac").when(ua.rlike("linux|x11"), "Linux").otherwise("unknown")


def human_url(official: Column, api_url: Column, raw_url: Column, *, safe_only: bool = True) -> Column:
    """struct(url, state): the official page, else the API's, else none."""
    full = F.when(strip(official).startswith("/"), F.concat(F.lit(WEB_BASE), strip(official))).otherwise(strip(official))
    fallback = F.when(text(api_url) != "", api_url)
    if not safe_only:
        fallback = F.coalesce(fallback, F.when(text(raw_url).startswith("/api/"), F.concat(F.lit(WEB_BASE), raw_url)))
    url = F.when(full.rlike("^https?://") & full.contains(OFFICIAL_HOST), full)
    state = F.when(url.isNotNull(), "resolved_official").when(fallback.isNotNull(), "fallback_api").otherwise("unresolved")
    return F.struct(F.coalesce(url, fallback, F.lit("")).alias("url"), state.alias("state"))


def lookup_url(metadata: Column, url: Column) -> Column:
    """struct(url, mode): where a notice's detail can be asked for, and the rule that found it."""
    given = lambda k: F.when(text(metadata[k]).contains("/api/tender"), strip(metadata[k]))
    unit, job = first_text(metadata["g0v_unit_id"], metadata["unit_id"]), first_text(metadata["g0v_job_number"], metadata["job_number"])
    quote = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    choices = [
        ("metadata_g0v_tender_api_url", given("g0v_tender_api_url")),
        ("metadata_tender_api_url", given("tender_api_url")),
        ("record_url", F.when(text(url).contains("/api/tender"), url)),
        ("unit_id_job_number", F.when((unit != "") & (job != ""), F.concat(F.lit(f"{API_BASE}/tender?unit_id="), quote(unit), F.lit("&job_number="), quote(job)))),
    ]
    found = [F.when(c.isNotNull(), F.struct(c.alias("url"), F.lit(mode).alias("mode"))) for mode, c in choices]
    return F.coalesce(*found, F.struct(F.lit("").alias("url"), F.lit("missing_lookup_key").alias("mode")))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any word is a substring: one alternation. An empty list matches nothing."""
    return c.rlike("|".join(re.escape(w) for w in dict.fromkeys(words))) if words else F.lit(False)


def gate_text(title: Column, summary: Column | None = None, category: Column | None = None) -> Column:
    parts = [text(c) if c is not None else F.lit("") for c in (title, summary, category)]
    return F.lower(F.concat_ws(" ", *parts))


def source_rank(source: Column, pack: RulePack) -> Column:
    out = F
    for name, rank in pack.source_priority.items():
        out = out.when(source == name, rank)
    return out.otherwise(1) if out is not F else F.lit(1)
