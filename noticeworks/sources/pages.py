"""Listing and detail pages as tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.amounts import bond_value, parse_amount
from noticeworks.functions.classify import is_educational
from noticeworks.functions.dates import parse_day
from noticeworks.functions.text import normalize_text, resolve_url, strip, text

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
TITLE_LENGTH = 300
COMPUTERS = "電腦類"
#: Labels of the fields of a detail page, and labels that must not be taken for them.
FIELDS = {
    "budget": (["預算金額"], ["預算金額是否公開"]), "budget_public": (["預算金額是否公開"], []), "bond": (["是否須繳納押標金", "押標金額度", "押標金"], ["履約", "保固", "手續費"]), "deadline": (["截止投標"], []), "opening": (["開標時間"], []),
    "organization": (["機關名稱", "招標機關", "洽辦機關"], []), "contact": (["聯絡人", "聯絡資訊", "承辦人"], []), "phone": (["聯絡電話", "電話"], []), "award_method": (["決標方式"], []),
}


def plain(html: Column) -> Column:
    """Text of an HTML fragment without its tags."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def page_links(pages: DataFrame, *, base: str | None = None, html: str = "html") -> DataFrame:
    """(page_id, pos, href, title): every anchor with text, in order; titles cut to 300. Native."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 2).alias("body"))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    link = resolve_url(base, F.col("a.href")) if base else F.col("a.href")
    return rows.select("page_id", "pos", link.alias("href"), F.left(plain(F.col("a.body")), F.lit(TITLE_LENGTH)).alias("title")).filter("title <> ''")


def first_match(html: Column, patterns: list[str]) -> Column:
    """The text of the first pattern (with one group) that finds any."""
    return F.coalesce(*(F.nullif(plain(F.regexp_extract(html, p, 1)), F.lit("")) for p in patterns), F.lit(""))


def listing_rows(pages: DataFrame, *, row: str, fields: dict[str, list[str]], base: str, source: str) -> DataFrame:
    """Notices of listing pages. ``row`` finds a row's HTML; ``fields`` has patterns for title, organization,
    date, amount, summary, category and link. A page without rows falls back to its anchors."""
    cut = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(row), 1)).alias("pos", "body"))
    get = lambda f: first_match(F.col("body"), fields.get(f, [])) if fields.get(f) else F.lit("")
    link = F.coalesce(*(F.nullif(F.regexp_extract("body", p, 1), F.lit("")) for p in fields.get("link", [r"href=[\"']([^\"']*)"])), F.lit(""))
    listed = cut.select("page_id", "pos", F.left(F.coalesce(F.nullif(get("title"), F.lit("")), plain(F.col("body"))), F.lit(TITLE_LENGTH)).alias("title"), get("organization").alias("organization"), get("date").alias("date_text"), get("amount").alias("amount_raw"), get("summary").alias("summary"), get("category").alias("category"), resolve_url(base, link).alias("url"))
    bare = page_links(pages.join(cut.select("page_id").distinct(), "page_id", "left_anti"), base=base).select("page_id", "pos", "title", F.col("href").alias("url"))
    rows = listed.unionByName(bare, allowMissingColumns=True).filter("title <> ''").fillna("")
    return rows.withColumns({"bid_date": parse_day(F.col("date_text")), "amount_value": parse_amount(F.col("amount_raw")), "bid_deadline": F.col("date_text"), "source": F.lit(source)})


def mark_candidates(df: DataFrame) -> DataFrame:
    """candidate_only, and the hint for computers at educational organisations."""
    computers = normalize_text(F.col("category")).contains(COMPUTERS)
    return df.withColumns({"candidate_only": F.lit(True), "category_hint": F.when(computers & is_educational(F.col("organization")), "computer_edu")})


class _Labels(HTMLParser):
    """Adjacent cells of table rows, and ``label: value`` texts of cells and labels."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.noted: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th", "label", "legend"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag == "tr" and self.rows:
            cells = self.rows.pop()
            self.out += zip(cells, cells[1:], strict=False)
        elif any(t == tag for t, _ in self.open):
            while self.open:
                t, parts = self.open.pop()
                body = " ".join(" ".join(parts).split())
                if t in ("td", "th") and self.rows:
                    self.rows[-1].append(body)
                self.noted.append(body)
                if t == tag:
                    break

    def handle_data(self, data):
        for _, parts in self.open:
            parts.append(data)


def _clean(value: str) -> str:
    return " ".join(value.replace("　", " ").split()).strip(" ：:")


def labelled_values(html: str | None) -> list[tuple[str, str]]:
    """(label, value) in the order of a page: table cells first, then ``label: value`` texts."""
    parser = _Labels()
    parser.feed(html or "")
    parser.close()
    pairs = list(parser.out)
    for body in parser.noted:
        for colon in ("：", ":"):
            label, found, value = body.partition(colon)
            if found and 2 <= len(label) <= 24 and "：" not in label and ":" not in label and value.strip():
                pairs.append((label, value))
                break
    cleaned = ((_clean(a), _clean(b)) for a, b in pairs)
    return [(a, b) for a, b in cleaned if a and b and a != b]


def page_labels(pages: DataFrame) -> DataFrame:
    """(page_id, pos, label, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, a, b) for i, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for k, (a, b) in enumerate(labelled_values(h))]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["page_id", "pos", "label", "value"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, pos int, label string, value string")


def pick_fields(labels: DataFrame, fields: dict[str, tuple[list[str], list[str]]] = FIELDS) -> DataFrame:
    """A row for each page with the first value of each field whose label holds a wanted and no excluded one.

    A label repeated at the start of the value is cut off. Labels count in order of first appearance."""
    label = F.regexp_replace("label", r"[\s：:]", "")
    seen = labels.withColumn("label_at", F.min("pos").over(_by_label()))
    out = []
    for name, (wanted, excluded) in fields.items():
        value = strip(F.regexp_replace(F.col("value"), "^(?:" + "|".join(wanted) + r")[：:\s]*", ""))
        ok = label.rlike("|".join(wanted)) & (~label.rlike("|".join(excluded)) if excluded else F.lit(True)) & (value != "")
        out.append(F.min_by(value, F.when(ok, F.struct("label_at", "pos"))).alias(name))
    return seen.groupBy("page_id").agg(*out)


def _by_label():
    from pyspark.sql import Window

    return Window.partitionBy("page_id", "label")


def apply_details(df: DataFrame, picked: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Notices with the picked values, which never erase what a list already said."""
    joined = df.join(picked.withColumnsRenamed({c: f"_{c}" for c in picked.columns if c != key}), key, "left")
    parsed = parse_amount(F.col("_budget"))
    shown = F.concat(F.lit("NT$ "), F.format_number(parsed, 0), F.lit(" 元"))
    budget = text(F.col("budget_amount"))
    said = F.when(F.col("_budget_public").startswith("否") & F.col("amount_value").isNull() & (budget == ""), "未公開").when(F.col("_budget_public").startswith("是") & F.col("amount_value").isNull() & (budget == "") & (strip(F.col("amount_raw")) == ""), "已公開（金額見詳細頁）")
    bond = F.when((strip(F.col("bid_bond")) == "") | F.col("bid_bond").isin("需繳納", "未公開", "無提供"), F.when(F.col("_bond").isNotNull(), bond_value(F.col("_bond"))))
    changed = {
        "budget_amount": F.coalesce(shown, said, budget), "amount_raw": F.coalesce(shown, F.col("amount_raw")), "amount_value": F.coalesce(parsed, F.col("amount_value")), "bid_bond": F.coalesce(bond, text(F.col("bid_bond"))), "bid_deadline": F.coalesce("_deadline", text(F.col("bid_deadline"))),
        "bid_opening_time": F.coalesce("_opening", text(F.col("bid_opening_time"))), "organization": F.when(text(F.col("organization")) == "", text(F.col("_organization"))).otherwise(F.col("organization")),
    }
    extra = {"contact_info": F.when(F.col("_contact").isNotNull(), strip(F.concat_ws(" ", "_contact", "_phone"))), "award_method": F.col("_award_method"), "bid_bond_raw": F.left("_bond", F.lit(100))}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in df.columns), *(v.alias(k) for k, v in extra.items()))


