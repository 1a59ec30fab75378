"""Selectors and listing rows on small pages."""

from __future__ import annotations

from datetime import date

import pytest

from noticeworks.sources.selectors import Page, listed, parse_selector, selected_rows

PAGE = """<html><body><div id="top" class="a b"><p>one</p><p class="x">two<b>three</b></p><span data-k="v-1" lang="zh-TW"/>
<ul><li>1<ul><li class="x">1.1</li></ul></li><li>2</li></ul><script>var t = "<p>no</p>";</script><br><IMG SRC=q></div><p>out</p></body></html>"""


def texts(selector):
    page = Page(PAGE)
    return [page.text(t) or t.name for t in page.select(selector)]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p", ["one", "two three", "out"]), ("div p", ["one", "two three"]), ("body > p", ["out"]), ("div>p.x b", ["three"]), ("#top > .x", ["two three"]), (".a.b", ["one two three 1 1.1 2"]), (".a .x", ["two three", "1.1"]), ("li li", ["1.1"]), ("ul > li", ["1 1.1", "1.1", "2"]),
        ("div > ul > li", ["1 1.1", "2"]), ("[data-k]", ["span"]), ("[data-k=v-1]", ["span"]), ('span[data-k^="v"][lang|=zh]', ["span"]), ("[data-k$='2']", []), ("[data-k*='-']", ["span"]), ("p:nth-child(2)", ["two three", "out"]), ("p:first-child", ["one"]), ("li:last-child", ["1.1", "2"]), ("*.x > *", ["three"]), ("img", ["img"]), ("body div p b", ["three"]), ("script", ["script"]), ("table", []),
    ],
)
def test_selectors(selector, want):
    assert texts(selector) == want


@pytest.mark.parametrize("bad", ["", ">", "p >", "> p", "p:hover", "p +q", "a[", "p,,q"])
def test_selectors_that_cannot_be_read(bad):
    with pytest.raises(ValueError, match="cannot read"):
        parse_selector(bad)


LISTING = """<table><tbody><tr><td>115/05/02</td><td>採購一</td><td>甲校</td><td>說明</td><td>1,250萬</td><td>電腦類</td></tr>
<tr><td>115/05/03<table><tbody><tr><td>inner</td></tr></tbody></table></td><td><a href="/x?1">採購二</a><td class=unit>乙校</tr><tr><td></td></tr></tbody></table><a href="/no">not a row</a>"""


def test_rows_of_a_listing(spark):
    """Nested tables are rows of their own; cells that are not closed nest; a link's text comes before a cell's."""
    pages = spark.createDataFrame([("p1", LISTING), ("p2", None), ("p3", "<a href='/only'>only <b>this</b></a><a></a>"), ("p4", "<div class='list-group-item x'><i class='subject'>one</i><time>2026/5/1</time></div>")], "page_id string, html string")
    got = selected_rows(pages, base="https://h/a/b", source="s").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.title, r.organization, r.url) for r in got] == [
        ("p1", 0, "採購一", "甲校", ""), ("p1", 1, "採購二", "乙校", "https://h/x?1"), ("p1", 2, "inner", "", ""), ("p3", 0, "only this", "", ""), ("p4", 0, "one", "", ""),
    ]
    assert (got[0].bid_date, got[0].amount_value, got[0].summary, got[0].category) == (date(2026, 5, 2), 12_500_000.0, "說明", "電腦類")
    assert got[1].date_text == "115/05/03 inner"


def test_the_first_selector_with_rows_counts():
    html = "<ul><li><a href=1>x</a></li></ul><div class=result-item>y<a>z</a></div>"
    assert [r["title"] for r in listed(html, ["li", ".result-item"], {"title": ["b", "a"]})] == ["x"]
    assert [r["title"] for r in listed(html, ["table", ".result-item"], {"title": ["b"]})] == ["y z"]
