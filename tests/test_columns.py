"""Column functions against cases of the reference's kind."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import amounts as A
from noticeworks.functions import classify as C
from noticeworks.functions import dates as D
from noticeworks.functions import keys as K
from noticeworks.functions import text as X


@pytest.mark.parametrize(("raw", "want"), [(" 國立臺灣大學－資訊設備 採購 ", "國立台灣大學資訊設備採購"), ("ＡＢＣ１２", "abc12"), ("a\x1fb", "ab"), ("", ""), (None, "")])
def test_normalize_text(one, raw, want):
    assert one(X.normalize_text, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1,250萬", 12_500_000), ("新臺幣3萬元整", 30_000), ("1億2,500萬", 125_000_000), ("預算金額：9,500,000元 截止投標：115/05/05 17:00", 9_500_000), ("押標金手續費：20元", None), ("押標金額度為標價之5%", None), ("詳見連結", None), ("12345", 12345), ("999", None), ("1 2", None),
        ("115年3月5日", None), ("", None), (None, None), ("0萬", None), ("NT$ 1,234.50", 1234.5),
    ],
)
def test_parse_amount(one, raw, want):
    assert one(A.parse_amount, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("114/03/24", date(2025, 3, 24)), ("20260430", date(2026, 4, 30)), ("1150430", date(2026, 4, 30)), ("37/04/30", None), ("2026-4-3", None), ("2026/04/30 17:00", None), ("115/02/30", None), ("4/3/2026", date(2026, 4, 3)), ("x", None), (None, None)])
def test_parse_day(one, raw, want):
    assert one(D.parse_day, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("115/04/29 17:00", (date(2026, 4, 29), 1020)), ("2026-04-30", (date(2026, 4, 30), None)), ("無提供", None), ("115/04/29 25:00", (date(2026, 4, 29), None)), (None, None)])
def test_parse_deadline(one, raw, want):
    got = one(D.parse_deadline, raw)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("raw", "want"), [("115/04/29 11:59", True), ("115/04/29 12:01", False), ("115/04/29", False), ("115/04/28", True), ("無提供", False), (None, False)])
def test_expired(one, raw, want):
    now = F.lit(datetime(2026, 4, 29, 12, 0))
    assert one(lambda c: D.is_expired(c, now), raw) is want


def test_deadline_shown(one):
    assert one(D.show_deadline, "115/4/9 7:05") == "2026/04/09 07:05"
    assert one(D.show_deadline, "?") == "?"


@pytest.mark.parametrize(("org", "want"), [("台大醫院", False), ("台大醫學院", True), ("國立台灣大學醫學院附設醫院", False), ("臺北市教育局", True), ("", False), (None, False)])
def test_educational(one, org, want):
    assert one(C.is_educational, org) is want


@pytest.mark.parametrize(("org", "want"), [("國防大學", "軍校"), ("德霖技術學院", "專科"), ("臺北市教育局", "教育局處"), ("師大附中", "高中職"), ("某國小", "國中小"), ("某大學", "大學"), ("某高職", "高中職"), ("x", "其他")])
def test_unit_type(one, org, want):
    assert one(C.unit_type, org) == want


def test_theme_and_conditions(one):
    theme = lambda t: one(lambda c: C.has_theme(c, F.lit(""), F.lit("")), t)
    assert theme("防火牆") and not theme("防火牆與消防")
    assert not theme("工作站") and theme("工作站 GPU")
    assert theme("教務處教學設備") and not theme("教學設備")
    assert theme("fees")  # words match inside words


def test_close_amounts(one):
    close = lambda a, b: one(C.amounts_close, a, b, kind="double")
    assert close(None, 1.0) and close(10_000.0, 15_000.0) and close(1_000_000.0, 1_050_000.0) and not close(10_000.0, 15_001.0)


def test_amount_key_rounds_half_to_even(one):
    key = lambda v: one(lambda c: A.amount_key(c, F.lit("raw")), v, kind="double")
    assert (key(2.5), key(3.5), key(None)) == ("2", "4", "raw")


def test_bonds(one):
    assert one(A.bond_value, "否") == "免繳"
    assert one(A.bond_value, "是 押標金額度：標價百分之5 廠商線上繳納押標金手續費：20元") == "5%"
    assert one(A.bond_value, "押標金額度：50,000元") == "NT$ 50,000 元"
    assert one(A.bond_value, "是") == "需繳納"
    assert one(A.bond_text, "") == "" and one(A.bond_text, "是") == "需繳納"


def test_urls(one):
    assert one(lambda u: X.query_value(u, "b"), "http://x/?a=1&b=%E5%A4%A7+x#f") == "大 x"
    assert one(lambda u: X.query_value(u, "b"), "http://x/?ab=1") == ""
    assert one(lambda u: X.resolve_url("https://h/a/b", u), "/c") == "https://h/c"
    assert one(X.url_key, " ") is None


def test_sources_and_log_fields(one):
    assert one(lambda c: X.append_source(c, F.lit("b")), "a+b") == "a+b"
    assert one(lambda e: X.log_number(e, "n"), "xn=3 n=12") == 12
    assert one(lambda e: X.log_literal(e, "result", anywhere=True), "a result={'x': True, 'y': None}") == '{"x": true, "y": null}'
    assert one(lambda e: X.sanitize(e, 6), "a [b]\n c d") == "a (b) "


LITERALS = [
    ("result={'a': {'b': [1, 2.5]}, 'c': None} tail={'d': 1}", '{"a": {"b": [1, 2.5]}, "c": null}'),
    ("""result={'error': "can't open {x}", 'ok': False}""", '{"error": "can\'t open {x}", "ok": false}'),
    ("""result={'error': 'said "no"', 't': (1, 'True')}""", '{"error": "said \\"no\\"", "t": [1, "True"]}'),
    ("result={'error': 'an open { bracket'}", None),
    ("result={'x': open}", None),
    ("result={'x': 1", None),
    ("result=none", None),
    ("other={'x': 1}", None),
    ("result={(1, 2): 3}", None),
    ("result={'名': '臺'}", '{"名": "臺"}'),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize(("extra", "want"), LITERALS)
def test_log_literals(one, extra, want):
    assert one(lambda e: X.log_literal(e, "result", anywhere=True), extra) == want


def test_a_literal_begins_after_its_key(one):
    assert one(lambda e: X.log_literal(e, "top"), "top= [('a', 2), ('b [x]', 1)] n=2") == '[["a", 2], ["b [x]", 1]]'
    assert one(lambda e: X.log_literal(e, "top"), "top=x [1]") is None
    assert one(lambda e: X.log_literal(e, "top", anywhere=True), "top=x {'a': 1}") == '{"a": 1}'


SAID = [
    "Thu, 30 Apr 2026 10:00", "Thu, 30 Apr 2026 10:00:59 GMT", "Thu, 30 Apr 2026 10:00 +0800", "April 30th, 2026", "the 1st of May 2026", "2026 Apr 30", "2026-Apr-30", "30-APR-2026", "Apr-2026-30", "Apr 30 26", "30 Apr 26", "26 30 Apr",
    "due Sept. 3, 2026 at 5 pm", "September 3 2026 5:30pm", "3 June 1999", "Feb 30, 2026", "7 Mar 2101", "4/30/2026", "2026.4.30", "30/04/2026", "37/04/30", "no date at all", "Mar 2026 maybe 3 or 4", "decide on 5 things 2026", "July 4, 76", "July 4, 75",
]


@pytest.mark.parametrize("said", SAID)
def test_days_in_words(one, said):
    """Against a fuzzy parser of the same texts, behind the same numeric forms."""
    import re

    from dateutil import parser

    def plain():
        digits = re.sub(r"\D", "", said)
        era = {8: (digits[:4], 0, 4), 7: (digits[:3], 1911, 3), 6: (digits[:2], 1911, 2)}.get(len(digits))
        if era and (len(digits) == 7 or digits.startswith(("19", "20")) == (len(digits) == 8)):
            year, at = int(era[0]) + era[1], era[2]
            try:
                if 2000 <= year <= 2100:
                    return date(year, int(digits[at : at + 2]), int(digits[at + 2 : at + 4]))
            except ValueError:
                pass
        if m := re.search(D.ROC_DATE, said):
            y, mo, d = map(int, m.groups())
            y += 1911 if y < 1911 else 0
            return date(y, mo, d) if 2000 <= y <= 2100 else None
        try:
            found = {parser.parse(said, fuzzy=True, default=datetime(*default)).date() for default in ((2020, 1, 1), (2021, 2, 2))}
        except (ValueError, OverflowError):
            return None
        return found.pop() if len(found) == 1 and 2000 <= min(found).year <= 2100 else None  # what a default fills in is no day

    assert one(D.parse_day, said) == plain()


def test_notification_keys(spark):
    row = spark.createDataFrame([({"pkPmsMain": "AB=="}, "https://x/?unit_id=3.79&job_number=7")], "m map<string,string>, url string")
    none = F.lit(None).cast("date")
    keys = row.select(K.notification_keys(title=F.lit("t"), org=F.lit("o"), amount=F.lit("1"), announced=none, due=F.lit("2026-01-02").cast("date"), url=F.col("url"), metadata=F.col("m")).alias("k")).first().k
    assert keys[:2] == ["source:gov_pcc:pkPmsMain:ab", "source:g0v:379:7"]
    assert keys[2].startswith("url:") and keys[3].startswith("fallback:title_org_amount:") and len(keys) == len(set(keys)) == 7


@pytest.mark.parametrize(("html", "status", "timed_out", "want"), [("", 403, False, "hard_block"), ("", 429, False, "rate_limited"), ("", 500, False, "unknown_failure"), ("驗證碼檢核", 200, False, "captcha"), ("Access  Denied", 200, False, "access_denied"), ("ok", 200, True, "timeout"), ("ok", 200, False, "success")])
def test_page_outcome(spark, html, status, timed_out, want):
    row = spark.createDataFrame([(html, status, timed_out)], "h string, s int, t boolean")
    assert row.select(C.page_outcome(F.col("h"), status=F.col("s"), timed_out=F.col("t")).alias("o")).first().o == want


def test_replies(one):
    good = one(C.parse_reply, '```json\n{"edu_score": 7, "it_score": 5, "priority": "high", "edu_reason": "a", "it_reason": "b"}\n```')
    assert (good.edu_score, good.it_score, good.priority, good.reason, good.error) == (7, 5, "high", "a | b", None)
    assert one(C.parse_reply, "nonsense").error == "bad_json"
    assert one(lambda c: C.parse_reply(c, validation=True), '{"confidence": 0.79}').it_score == 7


def test_high_amount(spark):
    rows = spark.createDataFrame([(20_000_000.0, "勞務", {}), (99_999_999.0, "財物", {}), (5_000_000.0, "財物", {"customer_tier": "A"}), (1.0, "其他", {"contract_years": "3 年"})], "a double, k string, m map<string,string>")
    got = [r.d for r in rows.select(C.high_amount(F.col("a"), F.col("k"), F.lit(""), F.lit(""), F.col("m")).alias("d")).collect()]
    assert [(d.is_high_amount, d.is_gigantic_amount) for d in got] == [(True, True), (True, False), (True, False), (True, False)]
    assert got[3].reasons == ["3年以上長約"]
