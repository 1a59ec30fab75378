"""API payloads as tables: list payloads, detail payloads, latest partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.amounts import bond_text, parse_amount
from noticeworks.functions.classify import is_public_tender
from noticeworks.functions.text import UNPUBLISHED, WEB_BASE, first_text, is_no, strip, text

LIST_SCHEMA = "records array<struct<unit_name:string,unit_id:string,job_number:string,date:bigint,url:string,tender_api_url:string,unit_api_url:string,brief:struct<type:string,title:string,category:string>>>"
#: Synonymous keys of the fields of a detail payload.
DETAIL = {
    "budget": ["採購資料:預算金額", "預算金額", "budget_amount", "budget"], "budget_public": ["採購資料:預算金額是否公開", "預算金額是否公開"], "bond": ["領投開標:是否須繳納押標金:押標金額度", "押標金額度", "押標金額", "bid_bond", "bidBond"],
    "bond_status": ["領投開標:是否須繳納押標金", "是否須繳納押標金"], "deadline": ["領投開標:截止投標", "截止投標", "bid_deadline", "deadline"], "opening": ["領投開標:開標時間", "開標時間", "bid_opening_time", "opening_time"],
    "contact": ["機關資料:聯絡人", "聯絡資訊", "contact_info", "contact"], "phone": ["機關資料:聯絡電話", "聯絡電話", "phone"], "award_method": ["招標資料:決標方式", "決標方式", "award_method", "awardMethod"], "organization": ["機關資料:機關名稱", "機關資料:單位名稱", "unit_name"],
}
NOT_GIVEN = "無提供"


def read_lists(spark, path: str) -> DataFrame:
    """List payloads, a JSON document a line; broken ones come as rows with _corrupt_record."""
    return spark.read.schema(LIST_SCHEMA + ", _corrupt_record string").json(path)


def list_notices(payloads: DataFrame) -> DataFrame:
    """A notice for each public tender with a title; relative URLs get the API's host."""
    rows = payloads.select(F.explode("records").alias("r")).filter(is_public_tender(F.col("r.brief.type")) & (strip(F.col("r.brief.title")) != ""))
    whole = lambda c: F.when(text(c).startswith("/"), F.concat(F.lit(WEB_BASE), c)).otherwise(text(c))
    day = F.try_to_date(F.col("r.date").cast("string"), "yyyyMMdd")
    meta = {"g0v_unit_id": F.col("r.unit_id"), "g0v_job_number": F.col("r.job_number"), "g0v_raw_url": F.col("r.url"), "g0v_tender_api_url": whole(F.col("r.tender_api_url")), "g0v_unit_api_url": whole(F.col("r.unit_api_url")), "g0v_type": F.col("r.brief.type")}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), text(v).alias("value")) for k, v in meta.items())), lambda e: e["value"] != "")
    return rows.select(
        strip(F.col("r.brief.title")).alias("title"), text(F.col("r.unit_name")).alias("organization"), day.alias("announcement_date"), F.lit(None).cast("date").alias("bid_date"), text(F.col("r.brief.category")).alias("category"), F.lit("").alias("summary"), F.lit("g0v").alias("source"),
        F.coalesce(F.nullif(whole(F.col("r.tender_api_url")), F.lit("")), whole(F.col("r.url"))).alias("url"), F.lit("").alias("amount_raw"), F.lit(None).cast("double").alias("amount_value"), F.map_from_entries(entries).alias("metadata"),
    )


def latest_partition(df: DataFrame, day: str, today: Column, back: int = 4) -> DataFrame:
    """Rows of the latest day that has any, from today back ``back`` days."""
    recent = df.filter(F.col(day).between(F.date_sub(today, back), today))
    return recent.join(F.broadcast(recent.agg(F.max(day).alias("_latest"))), F.col(day) == F.col("_latest")).drop("_latest")


def detail_object(payload: Column) -> Column:
    """A payload's detail: that of its first record, else the record, else itself; as a map of texts."""
    as_map = lambda path: F.from_json(F.get_json_object(payload, path), "map<string,string>")
    return F.coalesce(as_map("$.records[0].detail"), as_map("$.records[0]"), F.from_json(payload, "map<string,string>"))


def pick_text(detail: Column, keys: list[str]) -> Column:
    return first_text(*(detail[k] for k in keys))


def detail_fields(df: DataFrame, *, payload: str = "payload") -> DataFrame:
    """Adds budget_amount, amount_value, bid_bond, bid_deadline, bid_opening_time, contact_info, award_method and
    organization of a detail payload; what is not given says so."""
    rows = df.withColumn("_d", detail_object(F.col(payload)))
    rows = rows.withColumns({f"_f_{k}": pick_text(F.col("_d"), keys) for k, keys in DETAIL.items()})
    f = {k: F.col(f"_f_{k}") for k in DETAIL}
    hidden = is_no(f["budget_public"]) | (F.lower(text(F.col("_d")["budget_public"])) == "false")
    bond = F.nullif(bond_text(f["bond"], keep_plain=True), F.lit(""))
    status = F.nullif(bond_text(f["bond_status"]), F.lit(""))
    or_not = lambda c: F.when(c != "", c).otherwise(NOT_GIVEN)
    return rows.withColumns(
        {
            "budget_amount": F.when(f["budget"] != "", f["budget"]).when(hidden, UNPUBLISHED).otherwise(NOT_GIVEN), "amount_value": parse_amount(f["budget"]), "bid_bond": F.coalesce(F.when(bond != "需繳納", bond), status, bond, F.lit(NOT_GIVEN)), "bid_deadline": or_not(f["deadline"]),
            "bid_opening_time": or_not(f["opening"]), "contact_info": F.when(f["contact"] != "", strip(F.concat_ws(" ", f["contact"], f["phone"]))), "award_method": F.nullif(f["award_method"], F.lit("")), "organization": f["organization"],
        }
    ).drop("_d", *(f"_f_{k}" for k in DETAIL))


