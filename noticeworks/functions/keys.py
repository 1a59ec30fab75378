"""Keys of notices (C4-C8). They take a row's normalised title, organisation and amount key, so that these are made once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import content_uid
from .dates import effective_day
from .text import first_text, hash_key, normalize_text, query_value, text, url_key

PK = ("pkPmsMain", "pk_pms_main")
#: Where a tender's own number may stand.
TENDER_KEYS = ("tender_id", "tenderId", "job_number", "g0v_job_number", "case_number", "case_no", "標案案號")
TENDER_PARAMETERS = ("job_number", "tender_id", "case_no")
TENDER_TITLE = r"(?:案號|標案案號)[:：\s]*([A-Za-z0-9_-]{3,})"


def compact(*columns: Column) -> Column:
    """An array without nulls, empty texts and repeats, in order."""
    return F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")))


def source_parts(metadata: Column, url: Column) -> dict[str, Column]:
    """What a source's own key is made of: pk, or unit and job. Texts without them give ''."""
    places = (metadata["g0v_tender_api_url"], metadata["tender_api_url"], url)
    parts = {k: first_text(metadata[f"g0v_{name}"], metadata[name], *(query_value(p, name) for p in places)) for k, name in (("unit", "unit_id"), ("job", "job_number"))}
    return {"pk": first_text(*(metadata[k] for k in PK), query_value(url, PK[0]), query_value(metadata["g0v_human_url"], PK[0])), **parts}


def source_keys(parts: dict[str, Column], *, compose: bool = True) -> list[Column]:
    normal = lambda c: normalize_text(c, compose=compose)
    pk, unit, job = (parts[k] for k in ("pk", "unit", "job"))
    return [
        F.when(pk != "", F.concat(F.lit("source:gov_pcc:pkPmsMain:"), normal(pk))),
        F.when((unit != "") & (job != ""), F.concat(F.lit("source:g0v:"), normal(unit), F.lit(":"), normal(job))),
    ]


def notification_keys(*, title: Column, org: Column, amount: Column, announced: Column, due: Column, url: Column, metadata: Column, uid: Column | None = None, compose: bool = True, parts: dict[str, Column] | None = None) -> Column:
    """C4: all names of a notice, the strongest first: source, URL, content, older content forms, its own uid. ``parts``
    are those of ``source_parts`` where a plan has them as columns."""
    base = F.concat_ws("|", title, org, amount)
    named = (title != "") | (org != "")
    dated = lambda d: F.when(named & d.isNotNull(), hash_key("fallback:title_org_amount_date", F.concat_ws("|", base, d.cast("string"))))
    older = [content_uid(title, org, d, amount) for d in (due, announced, F.lit(None).cast("date"))]
    return compact(*source_keys(parts or source_parts(metadata, url), compose=compose), url_key(url), F.when(named, hash_key("fallback:title_org_amount", base)), dated(announced), dated(due), *older, text(uid) if uid is not None else F.lit(None).cast("string"))


def primary_key(keys: Column) -> Column:
    """C5."""
    return F.coalesce(F.get(keys, 0), hash_key("fallback:empty", F.lit("")))


def strong_keys(keys: Column) -> Column:
    """C6."""
    return F.filter(keys, lambda k: k.startswith("source:") | k.startswith("url:"))


def exact_key(title: Column, org: Column, announced: Column, due: Column, amount: Column) -> Column:
    """C7."""
    return F.concat_ws("|", title, org, F.coalesce(effective_day(announced, due).cast("string"), F.lit("")), amount)


def tender_ids(title: Column, url: Column, metadata: Column, *, compose: bool = True) -> Column:
    """C8."""
    normal = lambda c: normalize_text(c, compose=compose)
    return compact(*(normal(metadata[k]) for k in TENDER_KEYS), *(normal(query_value(url, k)) for k in TENDER_PARAMETERS), normal(F.regexp_extract(text(title), TENDER_TITLE, 1)))
