"""More registered queries: the daily run's smaller steps, queue and cache, digest, files, and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import amounts as A
from noticeworks.functions import classify as C
from noticeworks.functions import dates as D
from noticeworks.functions import keys as K
from noticeworks.functions import text as X
from noticeworks.keyed import KeyedTable
from noticeworks.operators import dedup, digest, gate, link, logs, recall, replies, standardize, state
from noticeworks.operators.notified import NotifiedState
from noticeworks.sources import api, files, pages, selectors
from noticeworks.tables import Snapshots, new_path

from noticeworks.streaming import monitor as streaming

from .monitor import complete
from .queries import _GATED, _TAGS, PACK, _doc_cache, _doc_rows, _log_lines, _order_rows, _state, notices, query, table

STRINGS = "array<string>"


def _pick(by, *values):
    """A column with values[i] where ``by`` modulo their number is i."""
    out = F
    for i, v in enumerate(values[:-1]):
        out = out.when(by % len(values) == i, v if not isinstance(v, str) else F.lit(v))
    return out.otherwise(values[-1] if not isinstance(values[-1], str) else F.lit(values[-1]))


def _case(by: str, *values: str) -> str:
    """The same in SQL."""
    rest = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {by} % {len(values)} {rest} ELSE {values[-1]} END"


def _lits(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


# Texts and amounts

_RAW = ("", " NONE ", "無提供", "詳見連結", "未提供", "已公開（金額見詳細頁）", "否，不需", "False", "n/a")
_IN = lambda values: "lower(trim(raw)) IN (" + ", ".join(_lits(*values)) + ")"


@query(
    f"""WITH r AS (SELECT *, {_case('o_orderkey', *_lits(*_RAW), 'o_orderpriority')} AS raw FROM orders)
    SELECT o_orderkey, {_IN(X.MISSING_DETAIL)} AS detail, {_IN(X.MISSING_CACHED)} AS cached, {_IN(X.MISSING_API)} AS api, {_IN(X.MISSING_DEADLINE)} AS deadline,
    starts_with(lower(trim(raw)), '否') OR lower(trim(raw)) IN ('no', 'false', '0') AS is_no, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS no_amount,
    coalesce(nullif(trim(raw), ''), nullif(trim(o_orderstatus), ''), '') AS first FROM r"""
)
def missing_values(spark, sf_dir):
    """F14, F18 (four sets), F19, F20."""
    raw = _pick(F.col("o_orderkey"), *_RAW, F.col("o_orderpriority"))
    amount = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    budget = F.when(F.col("o_orderkey") % 3 == 0, X.UNPUBLISHED).otherwise("")
    sets = {"detail": X.MISSING_DETAIL, "cached": X.MISSING_CACHED, "api": X.MISSING_API, "deadline": X.MISSING_DEADLINE}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(X.is_missing(raw, v).alias(k) for k, v in sets.items()), X.is_no(raw).alias("is_no"), X.missing_amount(amount, budget).alias("no_amount"), X.first_text(raw, F.col("o_orderstatus")).alias("first"))


@query(f"SELECT page_id, {_case('page_id', chr(39) * 2, 'url', _lits('https://www.example.com')[0] + chr(124) * 2 + _lits('/x/')[0] + ' || page_id', _lits('https://www.example.com/a/')[0] + chr(124) * 2 + _lits('y/')[0] + ' || page_id')} AS link FROM pages")
def resolved_urls(spark, sf_dir):
    """F15."""
    p = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", X.resolve_url("https://www.example.com/a/b", _pick(F.col("page_id"), "", F.col("url"), F.concat(F.lit("/x/"), p), F.concat(F.lit("y/"), p))).alias("link"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'as stated' ELSE 'NT$ ' || format('{:,}', trunc(o_totalprice)::BIGINT) END AS shown FROM orders")
def amount_shown(spark, sf_dir):
    """F24."""
    return table(spark, sf_dir, "orders").select("o_orderkey", A.format_amount(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.lit("as stated")).alias("shown"))


_PRICE = "format('{:,}', trunc(o_totalprice)::BIGINT)"


@query(
    f"""SELECT o_orderkey, {_case('o_orderkey', *_lits('免繳', '免繳', '5%'), f"'NT$ ' || {_PRICE} || ' 元'", *_lits('需繳納', '需繳納', 'NT$ 30,000 元'))} AS page,
    {_case('o_orderkey', *_lits('', '免繳', '5%'), _PRICE, *_lits('需繳納', '', '30,000'))} AS api FROM orders"""
)
def bond_texts(spark, sf_dir):
    """F16, F17."""
    price = F.concat(F.lit("新臺幣 "), F.format_number(F.col("o_totalprice").cast("long"), 0), F.lit(" 元"))
    raw = _pick(F.col("o_orderkey"), "免繳", "否", "押標金額度：百分之 5 手續費：1元", price, "是", "", "3萬元")
    return table(spark, sf_dir, "orders").select("o_orderkey", A.bond_value(raw).alias("page"), A.bond_text(raw).alias("api"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') ELSE coalesce(lang, '') || '+' || coalesce(source, '') END AS chain,
    CASE WHEN doc_id % 2 = 0 THEN '' WHEN lang = 'en' THEN 'English + ' ELSE lang || ' + ' END || source AS shown FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"""
)
def source_chains(spark, sf_dir):
    """F25."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    held = F.when(F.col("doc_id") % 2 == 1, F.concat_ws("+", "lang", "source"))
    chain = X.append_source(held, F.col("source"))
    return docs.select("doc_id", chain.alias("chain"), X.display_sources(chain, {"en": "English"}).alias("shown"))


@query(
    """WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS a, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + (o_orderkey % 2)::INT END AS d, o_totalprice * (1 + (o_orderkey % 10) / 50.0::DOUBLE) AS other FROM orders)
    SELECT o_orderkey, coalesce(a, d) AS day, coalesce(abs(date_diff('day', a, DATE '1997-06-01')) <= 200, false) AS near, a IS NOT DISTINCT FROM d AS same,
    o_orderkey % 7 = 0 OR abs(o_totalprice - other) <= 5000 OR abs(o_totalprice - other) / greatest(abs(o_totalprice), abs(other), 1.0) <= 0.05 AS close FROM o"""
)
def near_days_and_amounts(spark, sf_dir):
    """F26, P16, P17, P18."""
    day = F.to_date("o_orderdate")
    a, d = F.when(F.col("o_orderstatus") != "P", day), F.when(F.col("o_orderkey") % 5 > 0, F.date_add(day, (F.col("o_orderkey") % 2).cast("int")))
    price = F.col("o_totalprice")
    other = price * (1 + (F.col("o_orderkey") % 10) / F.lit(50.0))
    shown = F.when(F.col("o_orderkey") % 7 != 0, price)
    return table(spark, sf_dir, "orders").select("o_orderkey", D.effective_day(a, d).alias("day"), C.within_days(a, F.lit("1997-06-01").cast("date"), 200).alias("near"), C.same_day(a, d).alias("same"), C.amounts_close(shown, other).alias("close"))


@query(f"SELECT event_id, {_case('user_id', *_lits('Windows', 'Mac', 'Linux', 'unknown'))} AS platform FROM events")
def platforms(spark, sf_dir):
    """F30."""
    agent = _pick(F.col("user_id"), "Mozilla/5.0 (Windows NT 10.0; Win64)", "Mozilla/5.0 (Macintosh; Intel)", "Mozilla/5.0 (X11; Linux x86_64)", "curl/8")
    return table(spark, sf_dir, "events").select("event_id", X.platform(agent).alias("platform"))


@query(f"SELECT event_id, {_case('event_id', 'epoch(ts)::BIGINT', 'epoch(ts)::BIGINT', 'epoch(ts)::BIGINT - 28800', 'NULL')} AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def instants(spark, sf_dir):
    """with a zone, with Z, without, and no time at all."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = _pick(F.col("event_id"), F.concat(at, F.lit("Z")), at, F.concat(at, F.lit("+08:00")), "soon")
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(D.parse_instant(raw)).alias("at"))


def _links(spark, sf_dir) -> DataFrame:
    p, i = F.col("page_id").cast("string"), F.col("page_id")
    official = _pick(i, F.concat(F.lit("https://web.pcc.gov.tw/tps/"), p), "", F.concat(F.lit("/tps/"), p), "https://elsewhere.example/")
    api_url = F.when(i % 3 > 0, F.concat(F.lit("https://pcc-api.openfun.app/api/tender?unit_id="), p))
    return table(spark, sf_dir, "pages").select("page_id", "url", official.alias("official"), api_url.alias("api_url"), X.human_url(official, api_url, F.lit(None).cast("string")).alias("h"))


_LINKS = """WITH l AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://web.pcc.gov.tw/tps/' || page_id WHEN page_id % 3 > 0 THEN 'https://pcc-api.openfun.app/api/tender?unit_id=' || page_id ELSE '' END AS url,
    CASE WHEN page_id % 4 = 0 THEN 'resolved_official' WHEN page_id % 3 > 0 THEN 'fallback_api' ELSE 'unresolved' END AS state FROM pages)"""


@query(f"{_LINKS} SELECT page_id, url, state FROM l")
def human_links(spark, sf_dir):
    """F33."""
    return _links(spark, sf_dir).select("page_id", "h.url", "h.state")


@query(f"{_LINKS} SELECT count(*) AS n, count(*) FILTER (state = 'resolved_official') AS resolved_official, count(*) FILTER (state = 'fallback_api') AS fallback_api, count(*) FILTER (state = 'unresolved') AS unresolved FROM l")
def link_state_counts(spark, sf_dir):
    """A5."""
    return digest.link_states(_links(spark, sf_dir).select(F.when(F.col("h.state") == "unresolved", "odd").otherwise(F.col("h.state")).alias("link_state")))


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://x/api/tender?a=' || page_id WHEN 1 THEN 'https://y/api/tender?b=' || page_id WHEN 2 THEN 'https://z/api/tender/' || page_id WHEN 3 THEN 'https://pcc-api.openfun.app/api/tender?unit_id=3.79%20' || page_id || '&job_number=j' || page_id ELSE '' END AS url,
    CASE page_id % 5 WHEN 0 THEN 'metadata_g0v_tender_api_url' WHEN 1 THEN 'metadata_tender_api_url' WHEN 2 THEN 'record_url' WHEN 3 THEN 'unit_id_job_number' ELSE 'missing_lookup_key' END AS mode FROM pages"""
)
def lookup_urls(spark, sf_dir):
    """F34."""
    p, i = F.col("page_id").cast("string"), F.col("page_id") % 5
    meta = F.create_map(
        F.lit("g0v_tender_api_url"), F.when(i == 0, F.concat(F.lit("https://x/api/tender?a="), p)), F.lit("tender_api_url"), F.when(i == 1, F.concat(F.lit(" https://y/api/tender?b="), p)),
        F.lit("unit_id"), F.when(i == 3, F.concat(F.lit("3.79 "), p)), F.lit("g0v_job_number"), F.when(i == 3, F.concat(F.lit("j"), p)).otherwise("only a job"),
    )
    found = X.lookup_url(meta, F.when(i == 2, F.concat(F.lit("https://z/api/tender/"), p)).otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", found["url"].alias("url"), found["mode"].alias("mode"))


@query("SELECT o_orderkey, 'm' || o_orderkey || ',u' || (o_orderkey + 1) || CASE WHEN o_orderkey % 2 = 0 THEN ',a' || (o_orderkey + 2) ELSE '' END AS ids FROM orders WHERE o_orderkey > 99")
def tender_ids(spark, sf_dir):
    """Metadata, then the URL, then the title."""
    n = lambda k: (F.col("o_orderkey") + k).cast("string")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("採購 案號：A-"), n(2))).otherwise("採購")
    meta = F.create_map(F.lit("tender_id"), F.concat(F.lit("M"), n(0)), F.lit("case_no"), F.concat(F.lit("m-"), n(0)))
    ids = K.tender_ids(title, F.concat(F.lit("https://x/?q=1&job_number=U"), n(1)), meta, compose=False)
    return table(spark, sf_dir, "orders").filter("o_orderkey > 99").select("o_orderkey", F.array_join(ids, ",").alias("ids"))


@query(
    """WITH o AS (SELECT o_orderkey, replace(replace(lower(o_orderpriority), '-', ''), ' ', '') AS t, lower(o_orderstatus) AS g, CAST(o_orderdate AS DATE)::VARCHAR AS d, CAST(round_even(o_totalprice, 0) AS BIGINT)::VARCHAR AS a FROM orders)
    SELECT o_orderkey, ['fallback:title_org_amount:' || sha256(t || '|' || g || '|' || a), 'fallback:title_org_amount_date:' || sha256(t || '|' || g || '|' || a || '|' || d), sha256(t || '|' || g || '|' || d || '|' || a), sha256(t || '|' || g || '||' || a), 'own' || o_orderkey] AS keys,
    'fallback:title_org_amount:' || sha256(t || '|' || g || '|' || a) AS primary_key, t || '|' || g || '|' || d || '|' || a AS exact_key FROM o"""
)
def content_keys(spark, sf_dir):
    """C4 (content, older and own keys), C5, C7, by the key job."""
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("organization"), none.alias("url"), F.col("o_totalprice").alias("amount_value"), none.alias("amount_raw"), F.to_date("o_orderdate").alias("bid_date"), F.lit(None).cast("date").alias("announcement_date"), F.create_map().cast("map<string,string>").alias("metadata"), F.concat(F.lit("own"), F.col("o_orderkey").cast("string")).alias("uid"))
    return standardize.standardize_keys(rows, compose=False).select("o_orderkey", "keys", "primary_key", "exact_key")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(coalesce(text, '')), 'que') THEN 'three' END, CASE WHEN lang = 'fr' THEN '電腦' END], lambda t: t IS NOT NULL), ',') AS tags FROM documents WHERE contains(lower(coalesce(text, '')), 'que') OR lang = 'fr'")
def hinted_tags(spark, sf_dir):
    """The hint's tag comes last."""
    from dataclasses import replace

    pack = replace(PACK, tags={"three": ["que"]})
    rows = notices(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    tags = C.theme_tags(F.col("title"), F.col("summary"), F.col("category"), pack, F.when(F.col("lang") == "fr", pack.hint))
    return rows.select("doc_id", F.array_join(tags, ",").alias("tags")).filter("tags <> ''")


# Models

@query("SELECT doc_id, 'Title: ' || CASE WHEN doc_id % 3 = 0 THEN '未提供' ELSE lang END || ', place: ' || source AS prompt FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def prompts(spark, sf_dir):
    """C13."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    return docs.select("doc_id", C.prompt("Title: {title}, place: {place}", title=F.when(F.col("doc_id") % 3 > 0, F.col("lang")), place=F.col("source")).alias("prompt"))


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN '' ELSE 'high' END AS priority, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 0 ELSE 3 + l.quality END AS edu_score,
    CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 'a,b' ELSE 'a,b,c' END AS tags, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'm1' END, '') AS model FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def merged_replies(spark, sf_dir):
    """A scorer answers for labelled documents; toxic ones get a broken reply."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_ord"), F.col("lang").alias("title"), F.col("source").alias("organization"), F.lit("").alias("summary"), F.lit("").alias("ai_priority"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ingest_ord"), "quality", "toxic")

    def score(asked: DataFrame) -> DataFrame:
        good = F.to_json(F.struct((3 + F.col("quality")).alias("edu_score"), F.lit("high").alias("priority"), F.array(F.lit("b"), F.lit("c")).alias("suggested_tags")))
        return asked.join(labels, "ingest_ord").select("ingest_ord", F.when(F.col("toxic") == 1, "{not json").otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```"))).alias("reply"), F.lit("m1").alias("model"))

    done = replies.classify(rows, "{title} {organization} {summary}", score)
    return done.select(F.col("ingest_ord").alias("doc_id"), F.col("ai_priority").alias("priority"), F.col("ai_edu_score").alias("edu_score"), F.array_join("tags", ",").alias("tags"), F.coalesce("ai_model", F.lit("")).alias("model"))


@query("SELECT doc_id, length(coalesce(lang, '') || ' in ' || coalesce(source, '')) % 6 AS edu_score FROM documents WHERE doc_id % 5 < 4")
def asked_replies(spark, sf_dir):
    """C13-C15 with a scorer in the workers: equal prompts are asked once, later calls ask what is new."""

    def make():
        return lambda prompts: ['{"edu_score": %d}' % (len(p) % 6) for p in prompts]

    held = KeyedTable(spark, new_path(spark, "replies"), replies.REPLIES, ["hash"], buckets=8)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_ord"), F.coalesce("lang", F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("organization"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("tags"))
    score = lambda asked: replies.ask(asked, make, held, name="by length", per_round=50)
    replies.classify(rows.filter("ingest_ord % 5 < 2"), "{title} in {organization}", score).count()
    done = replies.classify(rows.filter("ingest_ord % 5 < 4"), "{title} in {organization}", score)
    return done.select(F.col("ingest_ord").alias("doc_id"), F.col("ai_edu_score").alias("edu_score"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 OR coalesce(source, '') = '' THEN '' ELSE source || ' ' END || coalesce(lang, '')) AS sha FROM documents WHERE lang IS NOT NULL")
def candidate_texts(spark, sf_dir):
    """C16."""
    said = recall.candidate_text(F.when(F.col("doc_id") % 2 == 1, F.col("source")), F.lit(""), F.col("lang"))
    return table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", F.sha2(said.cast("binary"), 256).alias("sha"))


@query("WITH c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, label AS category FROM (SELECT vec_id, vec_id % 13 AS idx FROM embeddings) LEFT JOIN c USING (idx)")
def category_lookup(spark, sf_dir):
    """An index out of range gives null."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.select("vec_id", (F.col("vec_id") % 13).cast("int").alias("idx"))
    return recall.category_by_index(asked, recall.category_vectors(vectors)).select("vec_id", "category")


# Digest

def _cards(spark, sf_dir) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("ingest_ord"), F.concat(F.repeat(F.lit("標題"), 130), k.cast("string")).alias("title"), F.col("o_orderstatus").alias("organization"), F.when(k % 3 == 0, "NT$ 5 元").otherwise("").alias("budget_amount"), F.when(k % 3 == 1, F.col("o_totalprice")).alias("amount_value"), F.lit("").alias("amount_raw"),
        F.when(k % 2 == 0, "無提供").otherwise(" 5% ").alias("bid_bond"), F.when(k % 4 == 0, "無").otherwise(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 9:05"))).alias("bid_deadline"), F.when(k % 2 == 0, "g0v+detail_cache").otherwise("gov_pcc").alias("source"),
        F.when(k % 5 > 0, F.concat(F.lit("https://x/"), k.cast("string"))).otherwise("x").alias("url"), F.when(p == "1-URGENT", "high").otherwise("low").alias("ai_priority"),
    )


_SHOWN = "CASE WHEN o_orderkey % 4 = 0 THEN '未提供' ELSE strftime(o_orderdate, '%Y/%m/%d') || ' 09:05' END"


@query(
    f"""SELECT o_orderkey AS ingest_ord, CASE o_orderkey % 3 WHEN 0 THEN 'NT$ 5 元' WHEN 1 THEN 'NT$ ' || {_PRICE} ELSE '未提供' END AS budget, CASE WHEN o_orderkey % 2 = 0 THEN '未提供' ELSE '5%' END AS bond, {_SHOWN} AS deadline,
    CASE WHEN o_orderkey % 2 = 0 THEN 'g0v 開放資料 + 細節快取' ELSE '政府採購網' END AS source, o_orderkey % 5 > 0 AS has_link FROM orders"""
)
def digest_cards(spark, sf_dir):
    """C17, F24, F25."""
    return digest.digest_cards(_cards(spark, sf_dir)).select("ingest_ord", F.col("shown_budget").alias("budget"), F.col("shown_bond").alias("bond"), F.col("shown_deadline").alias("deadline"), F.col("shown_source").alias("source"), "has_link")


@query(
    """SELECT day, '標案 ' || day || ' | ' || n || ' 筆' || CASE WHEN e IS NULL THEN '' ELSE ' | 最早截止 ' || e END AS subject FROM
    (SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n, strftime(min(o_orderdate) FILTER (o_orderkey % 4 > 0), '%Y/%m/%d') AS e FROM orders GROUP BY 1)"""
)
def digest_subjects(spark, sf_dir):
    """A subject for each day."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"), F.date_format(F.min(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate"))), "yyyy/MM/dd").alias("e"))
    return o.select(F.col("d").cast("string").alias("day"), digest.subject("標案", F.col("d"), F.col("n"), F.col("e")).alias("subject"))


@query(
    r"""SELECT o_orderkey AS ingest_ord, to_json({'title': left(repeat('標題', 130), 253) || '...', 'body': '機關: ' || o_orderstatus || chr(10) || '截止: ' || CASE WHEN o_orderkey % 4 = 0 THEN '無' ELSE strftime(o_orderdate, '%Y/%m/%d') || ' 9:05' END || chr(10) || '連結: ' || CASE WHEN o_orderkey % 5 > 0 THEN 'https://x/' || o_orderkey ELSE 'x' END,
    'labels': ['tender', 'high']})::VARCHAR AS payload FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def tracking_payloads(spark, sf_dir):
    """C20."""
    return digest.tracking_payload(_cards(spark, sf_dir), ["tender", "high"]).select("ingest_ord", "payload")


@query(
    """WITH m AS (SELECT o_orderkey, o_totalprice, 'deadline' AS field, 'label_not_found_or_empty' AS reason FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice, 'budget', CASE WHEN o_orderkey % 2 = 0 THEN 'parse_failed' ELSE 'label_not_found_or_empty' END FROM orders WHERE o_orderkey % 3 = 0)
    SELECT field, reason, left(repeat('長', 90), 80) AS title, 'u' || o_orderkey AS url, left(repeat('x', 300), 240) AS snippet FROM m"""
)
def field_misses(spark, sf_dir):
    """A17."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.repeat(F.lit("長"), 90).alias("title"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.repeat(F.lit("x"), 300).alias("snippet"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("115/1/1").alias("bid_deadline"), F.when(k % 3 != 0, "5").when(k % 2 == 0, "five").otherwise("").alias("budget_amount"))
    return digest.field_misses(rows, fields={"bid_deadline": "deadline", "budget_amount": "budget"}, unread={"budget_amount": F.col("budget_amount") == "five"})


@query("SELECT left(p_name, 200) AS title, left(p_brand, 120) AS organization, '' AS url, 'x(' || p_type || ')' AS raw, '需繳納' AS bid_bond FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 3")
def unparsed_samples(spark, sf_dir):
    """The first three."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ingest_ord"), F.col("p_name").alias("title"), F.col("p_brand").alias("organization"), F.lit("").alias("url"), F.concat(F.lit("x["), "p_type", F.lit("]")).alias("bid_bond_raw"), F.when(F.col("p_size") > 25, "需繳納").otherwise("10%").alias("bid_bond"))
    return digest.unparsed_bonds(rows, samples=3)[2]


@query("SELECT count(*) AS unparsed_count FROM part WHERE p_size > 25")
def unparsed_count(spark, sf_dir):
    """A4."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ingest_ord"), F.lit("").alias("title"), F.lit("").alias("organization"), F.lit("").alias("url"), F.col("p_type").alias("bid_bond_raw"), F.when(F.col("p_size") > 25, "未公開").otherwise("10%").alias("bid_bond"))
    return digest.unparsed_bonds(rows)[0]


# Gate and linkage

@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND (o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) >= DATE '1998-06-15')")
def active_rows(spark, sf_dir):
    """Neither expired nor a candidate."""
    raw = F.when(F.col("o_orderstatus") == "P", "另行通知").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("bid_deadline"), F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False).alias("candidate_only"))
    return gate.drop_candidates(gate.drop_expired(rows, F.lit("1998-06-15 12:00:00").cast("timestamp"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1 AND (o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1998-06-15')")
def listings_still_open(spark, sf_dir):
    """S2."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 > 0, F.to_date("o_orderdate")).alias("bid_date"), F.when(k % 4 == 1, "115/01/02 已決標").otherwise("115/01/02").alias("date_text"))
    return gate.drop_closed(rows, F.lit("1998-06-15").cast("date")).select("o_orderkey")


_BY_ID = "SELECT s_suppkey AS cand, count(c_custkey) AS n, min(c_custkey) AS target FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND replace(s_name, 'Supplier#', '') = replace(c_name, 'Customer#', '') GROUP BY s_suppkey"


def _exact_matches(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers and customers with one or, for every third supplier, two targets; no near titles."""
    day, ids = F.lit("2024-01-01").cast("date"), F.array().cast(STRINGS)
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    cand = s.select(F.col("s_suppkey").alias("cand"), ids.alias("ids"), F.col("s_nationkey").cast("string").alias("n_org"), F.regexp_replace("s_name", "^Supplier#", "").alias("n_title"), day.alias("day"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"), F.lit("電腦類").alias("category"), day.alias("bid_date"))
    once = c.select(F.col("c_custkey").alias("target"), ids.alias("ids"), F.col("c_nationkey").cast("string").alias("n_org"), F.regexp_replace("c_name", "^Customer#", "").alias("n_title"), day.alias("day"))
    twice = once.filter("target % 3 = 0").withColumn("target", F.col("target") + 1_000_000_000)
    targets = once.unionByName(twice)
    return cand, targets, link.match_hints(cand, targets, least=1.01)


@query(f"SELECT count(*) AS eligible, count(*) FILTER (n = 1 AND target % 3 > 0) AS matched, count(*) FILTER (NOT (n = 1 AND target % 3 > 0)) AS unmatched, count(*) FILTER (n = 1 AND target % 3 = 0) AS ambiguous FROM ({_BY_ID})")
def match_counts(spark, sf_dir):
    """A11, J4."""
    return link.match_summary(_exact_matches(spark, sf_dir)[2])


@query(f"WITH m AS ({_BY_ID}) SELECT c_custkey AS target, CASE WHEN cand IS NOT NULL THEN 'org_title_date' END AS match_method, 'u' || cand AS candidate_url, CASE WHEN cand IS NOT NULL THEN 'computer_edu' END AS category_hint FROM customer LEFT JOIN (SELECT * FROM m WHERE target % 3 > 0) t ON c_custkey = t.target")
def annotated_targets(spark, sf_dir):
    """The match and its hint on the targets."""
    cand, targets, matches = _exact_matches(spark, sf_dir)
    marked = link.annotate_targets(targets.filter("target < 1000000000"), matches, cand, propagate_hint=True)
    return marked.select("target", "match_method", "candidate_url", "category_hint")


@query("WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY user_id) SELECT c_custkey, kind, value FROM customer JOIN r ON c_custkey = user_id")
def joined_results(spark, sf_dir):
    """The last result of each URL."""
    results = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("result_ord"), F.col("event_type").alias("kind"), "value")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))
    return link.join_results(asked, results).select("c_custkey", "kind", "value")


# Duplicates

_RANKED = """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS p, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
  h AS (SELECT *, max(p) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e), w AS (SELECT *, held IS NULL OR p > held AS won FROM h)"""


@query(
    f"""{_RANKED} SELECT user_id, min(event_id) AS first_id, arg_max(event_id, event_id) FILTER (won) AS survivor, coalesce(arg_max(CAST(ts AS DATE), event_id) FILTER (won AND k % 2 = 0), arg_min(CAST(ts AS DATE), event_id) FILTER (k % 2 = 0)) AS day,
    coalesce(arg_max(k, event_id) FILTER (won AND k % 3 = 0), arg_min(k, event_id) FILTER (k % 3 = 0))::VARCHAR AS note, coalesce(arg_max(k, event_id) FILTER (won AND k % 5 = 0), arg_min(k, event_id) FILTER (k % 5 = 0))::VARCHAR AS unit, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tags,
    array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda s: s <> arg_max(event_type, event_id) FILTER (won))), ',') AS others, max(value) AS score FROM w GROUP BY user_id HAVING count(*) > 1"""
)
def merged_groups(spark, sf_dir):
    """Events of a user as copies of one notice: survivor, filled day and metadata, tags, other sources, score."""
    from dataclasses import replace

    from .monitor import complete

    k = F.get_json_object("props", "$.k").cast("int")
    entries = F.filter(F.array(F.struct(F.lit("note").alias("key"), F.when(k % 3 == 0, k.cast("string")).otherwise(" ").alias("value")), F.struct(F.lit("g0v_unit_id").alias("key"), F.when(k % 5 == 0, k.cast("string")).alias("value"))), lambda e: e["value"].isNotNull())
    rows = complete(table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_ord"), F.lit("t").alias("title"), F.lit("o").alias("organization"), F.col("event_type").alias("source"), F.when(k % 2 == 0, F.to_date("ts")).alias("bid_date"), F.map_from_entries(entries).alias("metadata"), F.col("event_id").cast("string").alias("uid"), F.lit("").alias("url")))
    more = table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_ord"), F.array("event_type").alias("tags"), F.col("value").alias("keyword_score"), F.col("user_id").alias("g"))
    several = more.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    pack = replace(PACK, source_priority={"purchase": 3, "signup": 2})
    done = dedup.merge_groups(rows.join(more.join(several, "g"), "ingest_ord"), "g", pack=pack)
    others = F.array_join(F.array_sort(F.split("backup_source", ",")), ",")
    return done.select(F.col("g").alias("user_id"), F.col("ingest_ord").alias("first_id"), F.col("uid").cast("long").alias("survivor"), F.col("bid_date").alias("day"), F.nullif(F.trim(F.col("metadata")["note"]), F.lit("")).alias("note"), F.col("metadata")["g0v_unit_id"].alias("unit"), F.array_join("tags", ",").alias("tags"), F.coalesce(others, F.lit("")).alias("others"), F.col("keyword_score").alias("score"))


def _months(spark, sf_dir) -> DataFrame:
    """Orders as complete notices; the customer's month is their address, their day and price band the title."""
    from .monitor import complete

    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return complete(o.select(F.col("o_orderkey").alias("ingest_ord"), F.concat_ws(" ", F.lit("order"), "o_orderpriority", F.floor(F.col("o_totalprice") / 100000)).alias("title"), F.col("o_orderstatus").alias("organization"), F.concat(F.lit("https://x/"), F.concat_ws("/", "o_custkey", F.date_format(day, "yyyy-MM"))).alias("url"), F.col("o_totalprice").alias("amount_value"), day.alias("bid_date"), F.lit("gov_pcc").alias("source"))).withColumn("tags", F.array("organization"))


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')) AS entry FROM orders")
def identity_entries(spark, sf_dir):
    """Orders that share their one address."""
    rows = standardize.standardize_keys(_months(spark, sf_dir), compose=False)
    return dedup.identity_entries(rows.withColumn("strong", K.strong_keys(F.col("keys")))).select(F.col("ingest_ord").alias("o_orderkey"), "entry")


@query()
def deduplicate(spark, sf_dir):
    """All passes; tests hold them against a sequential model."""
    done = dedup.deduplicate(standardize.standardize_keys(_months(spark, sf_dir), compose=False))
    return done.select("ingest_ord", "title", "amount_value", "bid_date", F.array_join("tags", ",").alias("tags"))


@query()
def fuzzy_dedup(spark, sf_dir):
    """D3: page titles of one host; tests hold it against a sequential model."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    rows = complete(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ingest_ord"), title.alias("title"), host.alias("organization"), "url", F.lit("gov_pcc").alias("source"))).withColumn("tags", F.array("organization"))
    keyed = standardize.standardize_keys(rows, compose=False).filter("n_title <> ''")
    return dedup.fuzzy_dedup(keyed).select("ingest_ord", "n_title", "n_org")


# State, cache and queue

@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderkey % 10 AS turn, CAST(o_orderdate AS DATE) AS day FROM orders),
    g AS (SELECT 'c:' || o_custkey AS primary_key, turn, arg_max(day, o_orderkey) AS day FROM b GROUP BY o_custkey, turn),
    l AS (SELECT primary_key, max(turn) AS turn FROM g GROUP BY primary_key)
    SELECT primary_key, CAST(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(turn AS INT)) AS TIMESTAMP) AS first_seen, day AS bid_date FROM g JOIN l USING (primary_key, turn)
    WHERE CAST(regexp_extract(primary_key, '[0-9]+') AS BIGINT) % 5 <> 0"""
)
def table_upsert(spark, sf_dir):
    """Ten batches of orders change a keyed table of customers; each writes what it changes, what is seen
    again starts anew, some entries are taken out, and the deltas are merged halfway."""
    held = KeyedTable(spark, new_path(spark, "state"), state.STATE_SCHEMA, ["primary_key"], buckets=8)
    rows = _order_rows(spark, sf_dir).withColumns({"primary_key": F.get("keys", 1), "announcement_date": F.lit(None).cast("date"), "bid_date": F.col("day"), "bid_deadline": F.lit("")})
    rows = rows.withColumns({"keys": F.array("primary_key"), "turn": F.col("ingest_ord") % 10})
    for turn in range(10):
        batch = rows.filter(F.col("turn") == turn)
        known = held.lookup(batch.select("primary_key"))
        now = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(turn))
        held.write(state.changed_entries(known, batch, now, by_alias=False))
        if turn == 4:
            held.compact()
    fifth = held.read().filter(F.regexp_extract("primary_key", r"(\d+)", 1).cast("long") % 5 == 0)
    held.write(held.read().limit(0), gone=fifth)
    return held.read().select("primary_key", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen"), "bid_date")


_CACHE = "SELECT 'd:' || doc_id AS primary_key FROM labels WHERE NOT (doc_id % 3 = 0 OR quality = 1)"


def _dated_cache(spark, sf_dir) -> DataFrame:
    """Labels as cached details: every third is past its time, those of quality past their deadline."""
    past, later = (F.lit(x).cast("timestamp") for x in ("2023-12-01", "2024-12-01"))
    i = F.regexp_extract("primary_key", r"(\d+)", 1).cast("long")
    deadline = F.when(F.col("budget_amount") == "NT$ 100", "112/12/30 17:00").otherwise("112/12/31")
    return _doc_cache(spark, sf_dir).withColumns({"expires_at": F.when(i % 3 == 0, past).otherwise(later), "bid_deadline": deadline})


@query(_CACHE)
def live_cache(spark, sf_dir):
    """P15, I4."""
    return state.prune_cache(_dated_cache(spark, sf_dir), F.lit("2024-01-01 12:00:00").cast("timestamp")).select("primary_key")


def _queue(spark, sf_dir) -> DataFrame:
    """Customers as queue entries, tried as often as their nation's number modulo 5 says."""
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("c:"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    source = F.when(F.col("c_custkey") % 2 == 0, "gov_pcc").otherwise("g0v")
    time = F.lit(None).cast("timestamp")
    return c.select(key.alias("primary_key"), F.array(key, F.concat(F.lit("n:"), F.col("c_name"))).alias("alias_keys"), source.alias("source"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("org"), key.alias("url"), F.lit("pending").alias("status"), F.create_map(source, F.col("c_nationkey") % 5).alias("attempt_counts"), F.lit("").alias("failure_reason"), time.alias("first_seen_at"), time.alias("last_attempt_at"))


@query("SELECT 'c:' || lpad(c_custkey::VARCHAR, 9, '0') AS primary_key FROM customer WHERE c_nationkey % 5 < 3 AND c_custkey % 2 = 0 ORDER BY 1 LIMIT 50")
def pending_rows(spark, sf_dir):
    """I6, T5."""
    return state.pending(_queue(spark, sf_dir), limit=50, sources=["gov_pcc"]).select("primary_key")


@query(
    """WITH f AS (SELECT user_id, count(*)::INT AS n, left(repeat('e', 300) || arg_max(event_id, event_id), 240) AS reason FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT 'c:' || lpad(c_custkey::VARCHAR, 9, '0') AS primary_key, CASE WHEN n IS NULL THEN 'pending' ELSE 'failed' END AS status, c_nationkey % 5 + coalesce(n, 0) AS tries, coalesce(reason, '') AS reason FROM customer LEFT JOIN f ON c_custkey = user_id"""
)
def marked_failures(spark, sf_dir):
    """I8."""
    key = F.concat(F.lit("c:"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    failures = table(spark, sf_dir, "events").filter("event_type = 'error'").select(key.alias("entry"), F.when(F.col("user_id") % 2 == 0, "gov_pcc").otherwise("g0v").alias("source"), F.concat(F.repeat(F.lit("e"), 300), F.col("event_id").cast("string")).alias("reason"), F.col("event_id").alias("at"))
    done = state.mark_failures(_queue(spark, sf_dir), failures, F.lit("2024-01-01").cast("timestamp"))
    return done.select("primary_key", "status", F.try_element_at("attempt_counts", F.col("source")).alias("tries"), F.col("failure_reason").alias("reason"))


def _attempts(spark, sf_dir) -> DataFrame:
    """Attempts for customers: a budget, an error, or nothing found; every fourth was not tried."""
    c, k = table(spark, sf_dir, "customer").filter("c_custkey % 4 < 3"), F.col("c_custkey") % 4
    key = F.concat(F.lit("c:"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    empty = {f: F.lit("") for f in state.DETAILS} | {"amount_value": F.lit(None).cast("double"), "official_url": F.lit("")}
    return c.select(key.alias("primary_key"), F.when(k == 1, "timeout").otherwise("").alias("error"), k.alias("k")).withColumns(empty).withColumn("budget_amount", F.when(F.col("k") == 0, "NT$ 9 元").otherwise("")).drop("k")


_OUTCOME = "CASE c_custkey % 4 WHEN 0 THEN 'success' WHEN 3 THEN 'skipped' ELSE 'failure' END"


@query(f"SELECT CASE WHEN c_custkey % 2 = 0 THEN 'gov_pcc' ELSE 'g0v' END AS source, {_OUTCOME} AS outcome, count(*) AS n FROM customer WHERE c_nationkey % 5 < 3 GROUP BY ALL")
def backfill_counts(spark, sf_dir):
    """I9, A14."""
    from .monitor import backfill

    cache = _doc_cache(spark, sf_dir).filter("false")
    return backfill(cache, _queue(spark, sf_dir), _attempts(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"), dry_run=True)[2]


@query(
    """SELECT 'c:' || lpad(c_custkey::VARCHAR, 9, '0') AS primary_key, CASE WHEN c_nationkey % 5 < 3 AND c_custkey % 4 = 1 THEN 'timeout' WHEN c_nationkey % 5 < 3 AND c_custkey % 4 = 2 THEN 'no_detail' ELSE '' END AS reason
    FROM customer WHERE NOT (c_nationkey % 5 < 3 AND c_custkey % 4 = 0)"""
)
def backfilled_queue(spark, sf_dir):
    """What is left in the queue after a round, with the last failure."""
    from .monitor import backfill

    cache = _doc_cache(spark, sf_dir).filter("false")
    queue = backfill(cache, _queue(spark, sf_dir), _attempts(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))[1]
    return queue.select("primary_key", F.col("failure_reason").alias("reason"))


@query("SELECT 'c:' || lpad(c_custkey::VARCHAR, 9, '0') AS primary_key, 'NT$ 9 元' AS budget, DATE '2024-03-31' AS expires FROM customer WHERE c_nationkey % 5 < 3 AND c_custkey % 4 = 0")
def backfilled_cache(spark, sf_dir):
    """New entries with their time to live."""
    from .monitor import backfill

    cache = _doc_cache(spark, sf_dir).filter("false")
    cache = backfill(cache, _queue(spark, sf_dir), _attempts(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))[0]
    return cache.select("primary_key", F.col("budget_amount").alias("budget"), F.to_date("expires_at").alias("expires"))


@query("SELECT (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 0 OR d.lang = 'en') AS entries, (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND coalesce(l.quality, 1) <> 0) AS added, (SELECT count(*) FROM documents WHERE lang = 'en') AS asked")
def queue_counts(spark, sf_dir):
    """A15."""
    rows = _doc_rows(spark, sf_dir).withColumn("lookup_url", F.col("url"))
    key = F.concat(F.lit("d:"), F.col("doc_id").cast("string"))
    time = F.lit(None).cast("timestamp")
    queue = table(spark, sf_dir, "labels").filter("quality = 0").select(key.alias("primary_key"), F.array(key).alias("alias_keys"), *(F.lit("gov_pcc" if c == "source" else "").alias(c) for c in ("source", "title", "org", "url", "status")), F.create_map().cast("map<string,int>").alias("attempt_counts"), F.lit("").alias("failure_reason"), time.alias("first_seen_at"), time.alias("last_attempt_at"))
    after = state.enqueue_missing(queue, rows, F.lit("2024-01-01").cast("timestamp"), sources=["gov_pcc"])
    return state.queue_counts(queue, after, rows.filter(C.should_backfill(F.col, ["gov_pcc"])))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 0 AND l.quality = 1 THEN 'g0v+detail_cache' ELSE 'g0v' END AS chain FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_chain(spark, sf_dir):
    """Where a row's details came from."""
    rows = _doc_rows(spark, sf_dir).withColumn("enrichment_source", F.lit("g0v"))
    return state.read_through(rows, _doc_cache(spark, sf_dir)).select(F.col("ingest_ord").alias("doc_id"), F.col("enrichment_source").alias("chain"))


# Payloads, pages and files

@query(
    """SELECT 'order ' || o_orderkey AS title, o_orderpriority AS organization, CAST(o_orderdate AS DATE) AS announced, 'https://pcc-api.openfun.app/api/tender?job_number=' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'unit ' || o_custkey END AS unit
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 > 0"""
)
def api_lists(spark, sf_dir):
    """Orders as list payloads; other types and rows without a title are left out."""
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "決標公告").otherwise("公開招標公告")
    title = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" order "), k.cast("string")))
    record = F.struct(F.col("o_orderpriority").alias("unit_name"), F.when(k % 2 == 0, F.concat(F.lit("unit "), F.col("o_custkey").cast("string"))).alias("unit_id"), k.cast("string").alias("job_number"), F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("date"), F.concat(F.lit("/index/"), k.cast("string")).alias("url"),
                      F.concat(F.lit("/api/tender?job_number="), k.cast("string")).alias("tender_api_url"), F.lit("").alias("unit_api_url"), F.struct(kind.alias("type"), title.alias("title"), F.lit("").alias("category")).alias("brief"))
    path = new_path(spark, "lists")
    table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(record).alias("records"))).alias("value")).write.text(path)
    rows = api.list_notices(api.read_lists(spark, path))
    return rows.select("title", "organization", F.col("announcement_date").alias("announced"), "url", F.col("metadata")["g0v_unit_id"].alias("unit"))


@query("SELECT p_partkey, true AS candidate_only, CASE WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 'computer_edu' END AS category_hint FROM part")
def marked_candidates(spark, sf_dir):
    """S5."""
    org = F.when(F.col("p_size") % 3 > 0, "某某大學").otherwise("某某公司")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "電 腦類").otherwise("圖書類").alias("category"), org.alias("organization"))
    return pages.mark_candidates(rows).select("p_partkey", "candidate_only", "category_hint")


@query(
    r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1)) AS body, generate_subscripts(regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1), 1) - 1 AS pos FROM pages),
    t AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_extract(body, '(?is)<a[^>]*>(.*?)</a>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS whole, regexp_extract(body, 'href=["'']([^"'']*)', 1) AS href FROM r)
    SELECT page_id, pos::INT AS pos, left(CASE WHEN a <> '' THEN a ELSE whole END, 300) AS title, CASE WHEN href = '' THEN '' WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN 'https://www.example.com' || href ELSE 'https://www.example.com/' || href END AS url
    FROM t WHERE CASE WHEN a <> '' THEN a ELSE whole END <> ''"""
)
def listing_rows(spark, sf_dir):
    """Rows found by patterns."""
    rows = table(spark, sf_dir, "pages").filter(F.col("html").rlike(r"(?is)<li>.*?</li>"))
    found = pages.listing_rows(rows, row=r"(?is)<li>(.*?)</li>", fields={"title": [r"(?is)<a[^>]*>(.*?)</a>"]}, base="https://www.example.com", source="gov_pcc")
    return found.select("page_id", "pos", "title", "url")


@query(
    r"""WITH h AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '(?s)<li><a href="([^"]*)">', 1) AS links FROM pages),
    l AS (SELECT page_id, unnest(links) AS link, unnest(range(len(links))) AS pos FROM h)
    SELECT page_id, CAST(pos AS INT) AS pos, substr(link, 2) AS title, 'https://www.example.com' || link AS url, '' AS organization FROM l"""
)
def selected_listings(spark, sf_dir):
    """Rows and fields by selectors, on the pages' own markup."""
    found = selectors.selected_rows(table(spark, sf_dir, "pages"), base="https://www.example.com", source="gov_pcc", rows=["table tbody tr", "nav > ul li"], fields={"title": ["h2", "li > a[href]"], "link": ["b", "a[href^='/']"]})
    return found.select("page_id", "pos", "title", "url", "organization")


@query("SELECT 'o:' || min(o_orderkey) AS primary_key, count(*) + 1 AS n_aliases, arg_max(o_orderpriority, o_orderkey) AS title, CAST(max(o_orderdate) AS DATE) AS bid_date FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY o_custkey")
def state_documents(spark, sf_dir):
    """State written as JSON documents and read back; a document that is broken gives nothing."""
    path = new_path(spark, "documents")
    entry = F.struct("alias_keys", "title", "org", "source", F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_seen_at"), F.col("bid_date").cast("string").alias("bid_date"))
    docs = _state(spark, sf_dir).select("primary_key", entry.alias("e")).groupBy(F.crc32(F.col("primary_key").cast("binary")) % 8).agg(F.map_from_entries(F.collect_list(F.struct("primary_key", "e"))).alias("entries"))
    whole = docs.select(F.to_json(F.struct(F.lit(2).alias("version"), "entries")).alias("value")).unionByName(spark.range(1).select(F.lit('{"entries": {"x": ').alias("value")))
    whole.write.option("maxRecordsPerFile", 1).text(path)
    return files.read_state(spark, path).select("primary_key", F.size("alias_keys").cast("long").alias("n_aliases"), "title", "bid_date")


@query(
    """SELECT 'd:' || doc_id AS primary_key, left(repeat(coalesce(source, '') || '"}' || chr(10) || '    }', 60), 300) AS title, left(repeat('x', 100 + CAST(doc_id % 200 AS INT)), 240) AS org, CASE WHEN doc_id % 4 = 0 THEN 'h' || doc_id ELSE 'u' || doc_id END AS official_url,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 1.5 END AS amount_value, 'a' AS note FROM documents"""
)
def detail_documents(spark, sf_dir):
    """Notices as cache entries, written as JSON documents, read entry by entry and turned back."""
    path = new_path(spark, "details")
    i = F.col("doc_id").cast("string")
    meta = F.create_map(F.lit("note"), F.lit("a"), F.lit("g0v_link_resolution_state"), F.when(F.col("doc_id") % 4 == 0, "fallback_api").otherwise("resolved_official"), F.lit("g0v_human_url"), F.concat(F.lit("h"), i))
    title = F.repeat(F.concat(F.coalesce("source", F.lit("")), F.lit('"}\n    }')), 60)  # what a broken reader would take for an entry's end
    rows = complete(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_ord"), title.alias("title"), F.repeat(F.lit("x"), (100 + F.col("doc_id") % 200).cast("int")).alias("organization"), F.concat(F.lit("u"), i).alias("url"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 1.5).alias("amount_value"), meta.alias("metadata")))
    keyed = rows.withColumn("primary_key", F.concat(F.lit("d:"), F.col("ingest_ord").cast("string"))).withColumn("keys", F.array("primary_key"))
    entries = state.cache_entries(keyed, "success", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    said = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("primary_key", F.struct(*entries.columns)))).alias("entries")), {"pretty": "true"})
    entries.groupBy(F.floor(F.regexp_extract("primary_key", r"(\d+)", 1).cast("long") / 100)).agg(said.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_details(spark, path)
    back = state.entry_notices(read).select("primary_key", "title", F.col("organization").alias("org"), "amount_value", F.col("metadata")["note"].alias("note"))
    return back.join(read.select("primary_key", "official_url"), "primary_key")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a,' || doc_id END AS aliases FROM documents")
def state_rows(spark, sf_dir):
    """Aliases as JSON text; bad JSON is an empty list."""
    raw = F.when(F.col("doc_id") % 3 == 0, "[oops").otherwise(F.concat(F.lit('["a", "'), F.col("doc_id").cast("string"), F.lit('"]')))
    return files.state_from_rows(table(spark, sf_dir, "documents").select("doc_id", raw.alias("alias_keys_json"))).select("doc_id", F.array_join("alias_keys", ",").alias("aliases"))


@query("SELECT 'u' || user_id AS url, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL")
def event_files(spark, sf_dir):
    """Files that hold a list, or an object with one."""
    path = new_path(spark, "events")
    event = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("outcome"))
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(event)).alias("list"))
    days.select(F.when(F.dayofmonth("d") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"events": '), "list", F.lit("}"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_events(spark, path).groupBy("url", "outcome").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS lines FROM events GROUP BY 1")
def log_files(spark, sf_dir):
    """Lines of log files, read in order; other lines are dropped, and so are repeats."""
    path = new_path(spark, "log")
    lines = _log_lines(spark, sf_dir)
    twice = lines.withColumn("value", F.explode(F.array(F.concat(F.lit("  at frame "), F.col("pos").cast("string")), "value")))
    numbered = twice.withColumn("value", F.when(F.col("value").startswith("  at"), F.col("value")).otherwise(F.concat("value", F.lit(" n="), F.col("pos").cast("string"))))
    numbered.repartition("file").sortWithinPartitions("file", "pos").select("file", "value").write.partitionBy("file").text(path)
    return logs.scan_log(files.read_log(spark, path)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("lines"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-15' AND event_type = 'purchase' AND dayofmonth(ts) % 3 <> 0) AND event_type = 'purchase'")
def latest_folder(spark, sf_dir):
    """From a table partitioned by day; folders whose rows are not wanted are passed over."""
    path = new_path(spark, "days")
    table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    wanted = lambda rows: rows.filter((F.col("event_type") == "purchase") & (F.dayofmonth("ts") % 3 != 0))
    return files.read_latest(spark, path, datetime.date(2024, 1, 15), accept=wanted).select("event_id")


@query("SELECT 'a' AS source, count(*) AS n, '' AS error FROM customer UNION ALL SELECT 'b', 0, 'failed' UNION ALL SELECT 'c', count(*), '' FROM supplier UNION ALL SELECT 'd', 0, 'failed'")
def union_of_sources(spark, sf_dir):
    """A source that fails does not stop the others."""

    def broken():
        return spark.read.parquet(f"{sf_dir}/none.parquet")

    def late():
        last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
        return table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("broken at its last row"))).otherwise(F.col("o_orderstatus")).alias("status"))

    rows, errors = files.union_sources({"a": lambda: table(spark, sf_dir, "customer").select("c_name"), "b": broken, "c": lambda: table(spark, sf_dir, "supplier").select("s_name"), "d": late})
    return gate.source_health(rows, ["a", "b", "c", "d"], errors={k: "failed" for k in errors}).select("source", "n", "error")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def snapshots(spark, sf_dir):
    """K1, K2: the latest whole version is read; older ones go."""
    held = Snapshots(spark, new_path(spark, "snapshots"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for part in (orders, orders.filter("o_orderkey % 3 = 0"), orders.filter("o_orderkey % 2 = 0")):
        held.write(part)
    return held.read("o_orderkey long, status string").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (value > 20)::INT AS ok, count(*) FILTER (NOT value > 20)::INT AS failed FROM events GROUP BY 1")
def source_states(spark, sf_dir):
    """A13."""
    status = F.struct(F.col("event_type").alias("source"), (F.col("value") > 20).alias("success"), F.lit(1).alias("count"), F.lit("").alias("error"))
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.collect_list(status).alias("source_status"))
    run = logs.run_sources(F.struct("source_status"))
    return days.select("day", run["ok"].alias("ok"), run["failed"].alias("failed"))


# Streams

@query(f"SELECT doc_id, array_to_string({_TAGS}, ',') AS tags FROM documents WHERE {_GATED}")
def streamed_gate(spark, sf_dir):
    """P9 over a watched folder, some files a micro-batch."""
    source, out = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    rows = notices(spark, sf_dir).repartition(6)
    rows.write.parquet(source)
    schema = "doc_id long, title string, organization string, summary string, category string, metadata map<string,string>"
    streaming.start_gate(spark, source, out, new_path(spark, "stream-checkpoint"), schema=schema, pack=PACK, files=2).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT 'c:' || o_custkey AS primary_key, count(*) > 0 AS held FROM orders GROUP BY o_custkey")
def streamed_state(spark, sf_dir):
    """J5, J8, K1 over micro-batches: each customer is notified once, whatever the batch."""
    source, held = new_path(spark, "stream-in"), new_path(spark, "stream-state")
    key = F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))
    date = F.lit(None).cast("date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ingest_ord"), F.array(key).alias("keys"), key.alias("primary_key"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("organization"), F.lit("gov_pcc").alias("source"), date.alias("announcement_date"), date.alias("bid_date"), F.lit("").alias("bid_deadline"))
    rows.repartition(3).write.parquet(source)
    schema = "ingest_ord long, keys array<string>, primary_key string, title string, organization string, source string, announcement_date date, bid_date date, bid_deadline string"
    streaming.start_notified(spark, source, held, new_path(spark, "stream-checkpoint"), schema=schema, files=1).awaitTermination()
    return NotifiedState(spark, held).read().select("primary_key", F.lit(True).alias("held"))


@query("SELECT 'c:' || c_custkey AS url, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def streamed_deliveries(spark, sf_dir):
    """J5, J8, P10, T1 over micro-batches with an outbox: the first delivery of each batch fails, some notices come in
    both batches, some are over. After a restart each of the others has been delivered once."""
    source, held, waiting, sent = (new_path(spark, n) for n in ("stream-in", "stream-state", "stream-outbox", "stream-sent"))
    c = table(spark, sf_dir, "customer")
    url = F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))
    due = F.when(F.col("c_custkey") % 5 == 0, "112/01/02 17:00").otherwise("299/12/31 17:00")
    rows = c.select(F.col("c_custkey").alias("ingest_ord"), F.concat(F.lit("資訊設備採購 "), F.md5("c_name")).alias("title"), F.concat(F.col("c_name"), F.lit(" 國小")).alias("organization"), F.lit("g0v").alias("source"), url.alias("url"), due.alias("bid_deadline"))
    rows = complete(rows)
    for part in (rows.filter("ingest_ord % 3 <> 0"), rows.filter("ingest_ord % 3 <> 1")):
        part.coalesce(1).write.mode("append").parquet(source)
    tried: set[int] = set()

    def deliver(new, number):
        if number not in tried:
            tried.add(number)
            return False
        new.select("url").write.mode("append").parquet(sent)
        return True

    checkpoint = new_path(spark, "stream-checkpoint")
    for _ in range(3):
        streaming.start_monitor(spark, source, held, waiting, checkpoint, deliver, files=1).awaitTermination()
    return spark.read.parquet(sent).groupBy("url").agg(F.count("*").alias("n"))
