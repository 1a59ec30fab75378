"""Listing rows by CSS selectors (S1): a tag tree of each page, built in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.amounts import parse_amount
from noticeworks.functions.dates import parse_day
from noticeworks.functions.text import resolve_url

TITLE_LENGTH = 300
# Where listings have their rows, and rows their fields, tried in this order; elements without an end, and
# those whose text is not shown.
ROWS = ["table tbody tr", ".result-item", ".list-group-item"]
FIELDS = {
    "title": ["a", ".title", ".subject", "td:nth-child(2)"], "organization": [".org", ".unit", "td:nth-child(3)"], "date_text": [".date", ".publish-date", "time", "td:nth-child(1)"], "amount_raw": [".amount", ".price", "td:nth-child(5)"],
    "summary": [".summary", ".desc", "td:nth-child(4)"], "category": [".category", ".type", "td:nth-child(6)"], "link": ["a"],
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}


@dataclass
class Tag:
    name: str
    attributes: dict[str, str]
    parent: Tag | None
    place: int  # among its parent's tags, from 1
    begin: int  # of its texts, and of the tags below it
    first: int
    end: int = 0
    last: int = 0
    children: int = 0


@dataclass
class Page(HTMLParser):
    """All tags and texts of a page in order. A tag's texts and the tags below it are ranges of them. An end closes the
    last open tag of its name and all that is open inside; one without a beginning is passed over."""

    html: str
    tags: list[Tag] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Tag("", {}, None, 1, 0, 0)
        self.open = [self.root]
        self.feed(self.html)
        self.close()
        self._end(len(self.open))

    def _end(self, n: int) -> None:
        for tag in self.open[len(self.open) - n :]:
            tag.end, tag.last = len(self.texts), len(self.tags)
        del self.open[len(self.open) - n :]

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1]
        parent.children += 1
        self.tags.append(Tag(tag, {k: v or "" for k, v in reversed(attrs)}, parent, parent.children, len(self.texts), len(self.tags) + 1))
        self.open.append(self.tags[-1])
        if tag in VOID:
            self._end(1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(1)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].name == tag), 0)
        if at:
            self._end(len(self.open) - at)

    def handle_data(self, data):
        if self.open[-1].name not in HIDDEN and data.strip():
            self.texts.append(data.strip())

    def text(self, tag: Tag) -> str:
        return " ".join(self.texts[tag.begin : tag.end])

    def select(self, selector: str, below: Tag | None = None) -> Iterator[Tag]:
        """Tags below ``below`` that match; what a selector says of ancestors may lie above it."""
        steps = parse_selector(selector)
        below = below or self.root
        return (t for t in self.tags[below.first : below.last] if matches(t, steps))


#: One condition of a selector: tag, id, class, attribute with a value, or place.
PART = re.compile(r"""(\*|[\w-]+)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:(first-child|last-child|nth-child\(\s*\d+\s*\))""")
HOLDS = {
    "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: v != "" and a.startswith(v), "$=": lambda a, v: v != "" and a.endswith(v), "*=": lambda a, v: v != "" and v in a, "|=": lambda a, v: a == v or a.startswith(v + "-"),
}


def _condition(part: re.Match):
    tag, id_, class_, name, how, *values, place = part.groups()
    value = next((v for v in values if v is not None), "")
    if tag:
        return lambda t: tag == "*" or t.name == tag.lower()
    if id_:
        return lambda t: t.attributes.get("id") == id_
    if class_:
        return lambda t: class_ in t.attributes.get("class", "").split()
    if name:
        return lambda t: name.lower() in t.attributes and (not how or HOLDS[how](t.attributes[name.lower()], value))
    if place == "last-child":
        return lambda t: t.place == t.parent.children
    nth = 1 if place == "first-child" else int(re.search(r"\d+", place)[0])
    return lambda t: t.place == nth


@lru_cache(maxsize=256)
def parse_selector(selector: str) -> list[tuple[str, list]]:
    """(combinator before it, conditions) of each step; combinators are ' ' (below) and '>' (right below)."""
    steps, at, how = [], 0, " "
    text = re.sub(r"\s*>\s*", ">", selector.strip())
    while at < len(text):
        conditions = []
        while part := PART.match(text, at):
            if part[1] and conditions:
                break
            conditions.append(_condition(part))
            at = part.end()
        gap = re.compile(r"\s+|>|$").match(text, at)
        if not conditions or not gap:
            raise ValueError(f"cannot read the selector {selector!r}")
        steps.append((how, conditions))
        how, at = (">" if gap[0] == ">" else " "), gap.end()
    if not steps or text.endswith(">"):
        raise ValueError(f"cannot read the selector {selector!r}")
    return steps


def matches(tag: Tag | None, steps: list[tuple[str, list]]) -> bool:
    *before, (how, conditions) = steps
    if tag is None or tag.parent is None or not all(c(tag) for c in conditions):
        return False
    if not before:
        return True
    above = tag.parent
    while how == " " and above and not matches(above, before):
        above = above.parent
    return matches(above, before)


def listed(html: str | None, rows: list[str], fields: dict[str, list[str]]) -> list[dict[str, str]]:
    """The fields of a page's rows: those of the first of ``rows`` that finds any, or else its links with text. A field is
    the text (a link: the address) of the first selector whose first tag has any; a title may also be the row's text."""
    page = Page(html or "")
    found = next((hit for hit in (list(page.select(s)) for s in rows) if hit), None) or [t for t in page.select("a") if page.text(t)]
    out = []
    for row in found:
        firsts = {name: (next(page.select(s, row), None) for s in selectors) for name, selectors in fields.items()}
        said = {name: next((v for t in tags if t and (v := t.attributes.get("href", "") if name == "link" else page.text(t))), "") for name, tags in firsts.items()}
        said["title"] = (said.get("title") or page.text(row))[:TITLE_LENGTH].strip()
        if said["title"]:
            out.append(said)
    return out


def selected_rows(pages: DataFrame, *, base: str, source: str, rows: list[str] | None = None, fields: dict[str, list[str]] | None = None, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Notices of listing pages: ``id_col``, pos, title (cut to 300), organization, date_text, amount_raw, summary,
    category and url, with bid_date, bid_deadline, amount_value and source. ``rows`` and ``fields`` are lists of CSS
    selectors (tags, ids, classes, attributes, places among siblings; below and right below), tried in order. Rows without
    a title are left out; null pages have none; a selector that cannot be read is an error."""
    rows, fields = rows or ROWS, FIELDS | (fields or {})
    for s in [*rows, *(s for all_ in fields.values() for s in all_)]:
        parse_selector(s)
    names = list(FIELDS)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time: its rows are a batch
                found = listed(batch.column(1)[i].as_py(), rows, fields)
                if found:
                    own = pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(len(found)), pa.int32()), *(pa.array([f[n] for f in found], pa.string()) for n in names)], ["id", "pos", *names])

    out = pages.select(id_col, html).mapInArrow(run, f"id {kind}, pos int, " + ", ".join(f"{n} string" for n in names))
    parsed = {"url": resolve_url(base, F.col("link")), "bid_date": parse_day(F.col("date_text")), "amount_value": parse_amount(F.col("amount_raw")), "bid_deadline": F.col("date_text"), "source": F.lit(source)}
    return out.withColumns(parsed).drop("link").withColumnRenamed("id", id_col)
