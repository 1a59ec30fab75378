"""Source divergence audit: how far the sources of a language lie from each other in their use of terms.

The divergence of two sources is a sum over terms of a price that depends on the two counts alone. So it follows from
their joint table: how many terms have count c in the one and d in the other. With an indicator column for each (source,
count), the product of that matrix's transpose with itself holds all joint tables. It is taken in blocks of terms and of
pairs of source blocks, each in a task, with float32 products that are exact (entries are counts of a block's terms,
below 2**24); prices are exact integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, store

SCALE = 1_000_000_000
#: A term, in UTF-8: ASCII letters and all characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counts of terms that a task holds before it passes them on.
HELD = 200_000
#: Terms and sources of a block, and columns (source, count) that are multiplied at a time.
TERMS, SOURCES, COLUMNS = 4096, 48, 1024


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        keys = [(*group, term, count, docs[group][term]) for group, terms in n.items() for term, count in terms.items()]
        lang, source, term, count, in_docs = zip(*keys, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(in_docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            counts, seen = n.setdefault(group, Counter()), set()
            held -= len(counts)
            for part in pieces(text[i].as_py().lower(), TERM):  # of bytes, lower() changes A-Z only
                found = TERM.findall(part)
                counts.update(found)
                seen.update(found)
            docs.setdefault(group, Counter()).update(seen)
            held += len(counts)
            if held > HELD:
                yield rows()
                n, docs, held = {}, {}, 0
    if held:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of columns lang, source and text without
    nulls. Tasks add up what they read before it moves."""
    partial = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact beyond 64 bits."""
    return (F.lit(1) + F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)"))).cast("long")


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` in 64 bits, by long division in steps of 1000; totals are below 2**53."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _columns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of counts (terms x sources): each column's source and count, and the column of each cell."""
    source = np.broadcast_to(np.arange(counts.shape[1]), counts.shape)
    level, at = np.unique(counts, return_inverse=True)
    column, cell = np.unique(source * len(level) + at.reshape(counts.shape), return_inverse=True)
    return column // len(level), level[column % len(level)], cell.reshape(counts.shape)


def _one_hot(cell: np.ndarray, low: int, high: int) -> np.ndarray:
    """The indicator columns low .. high - 1."""
    term, at = np.nonzero((cell >= low) & (cell < high))
    out = np.zeros((len(cell), high - low), np.float32)
    out[term, cell[term, at] - low] = 1
    return out


def joint_tables(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of two matrices of counts over the same terms (terms x sources), what occurs together, a block of columns by a
    block of columns: (left source, its count, right source, its count, number of terms)."""
    (ls, lc, l_cell), (rs, rc, r_cell) = _columns(left), _columns(right)
    for i in range(0, len(ls), COLUMNS):
        x = _one_hot(l_cell, i, min(i + COLUMNS, len(ls))).T
        for j in range(0, len(rs), COLUMNS):
            product = x @ _one_hot(r_cell, j, min(j + COLUMNS, len(rs)))
            a, b = np.nonzero(product)
            yield ls[i + a], lc[i + a], rs[j + b], rc[j + b], product[a, b].astype(np.int64)


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of terms (sorted by count) with about COLUMNS different (source, count): rare terms share their columns, and
    of frequent ones each has its own."""
    at, size = 0, len(counts)
    while at < len(counts):
        size = min(2 * size, len(counts) - at)
        while size > 32 and len(_columns(counts[at : at + size])[0]) > COLUMNS:
            size = (size + 1) // 2
        yield at, at + size
        at += size


def _price_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows without a term name the sources of the block (side 0: left, 1: right) and the number of its terms."""
    heads = rows[rows.term.isna()].sort_values(["side", "source"])
    body = rows[rows.term.notna()]
    diagonal = rows.i.iat[0] == rows.j.iat[0]
    left, right = heads[heads.side == 0], heads[heads.side == int(not diagonal)]
    if not len(left) or not len(right):
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": np.zeros(0, np.int64)})
    term, at = np.unique(body.term.to_numpy(str), return_inverse=True) if len(body) else (np.zeros(0), np.zeros(0, np.int64))
    place = {s: k for k, s in enumerate([*left.source, *([] if diagonal else right.source)])}
    counts = np.zeros((len(term), len(place)), np.int64)
    counts[at, body.source.map(place).to_numpy(np.int64)] = body.n.to_numpy(np.int64)
    counts = counts[np.argsort(counts.sum(1), kind="stable")]
    lt, rt = left.total.to_numpy(np.int64), right.total.to_numpy(np.int64)
    value, back = np.zeros((len(lt), len(rt)), np.int64), np.zeros((len(lt), len(rt)), np.int64)

    def add(g: np.ndarray, c: np.ndarray, h: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
        p, q = _share(c, lt[g]), _share(d, rt[h])
        gap = (p - q) * (p - q)
        np.add.at(value, (g, h), gap // q * n)
        if not diagonal:
            np.add.at(back, (g, h), gap // p * n)

    for a, b in _runs(counts):
        for table in joint_tables(counts[a:b, : len(lt)], counts[a:b, -len(rt) :]):
            add(*table)
    absent = int(heads.n.iat[0]) - len(term)  # terms of the block that none of these sources has
    if absent:
        g, h = np.indices(value.shape).reshape(2, -1)
        add(g, np.zeros_like(g), h, np.zeros_like(h), np.full_like(g, absent))
    g, h = np.indices(value.shape).reshape(2, -1)
    if diagonal:
        g, h = g[g != h], h[g != h]
    names, others = left.source.to_numpy(object), right.source.to_numpy(object)
    out = pd.DataFrame({"lang": rows.lang.iat[0], "source": names[g], "item": others[h], "value": value[g, h]})
    return out if diagonal else pd.concat([out, pd.DataFrame({"lang": rows.lang.iat[0], "source": others[h], "item": names[g], "value": back[g, h]})])


def audit_sources(docs: DataFrame, *, least_docs: int = 3, top_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from the others.

    A term is kept by a language if at least ``least_docs`` of its rows hold it. With V kept terms and N occurrences of
    them in a group (a source of the language) or in the language, a count has the share p = 1 + floor(SCALE *
    (count + 1) / (N + V)); the price of p against q is floor((p - q)**2 / q). Part ``pair``: for every other source of
    the language, the sum of prices over all kept terms. Part ``term``: the ``top_terms`` kept terms of the group whose
    share exceeds the language's by most, by price against it. Ranks are by value, then by the item in UTF-8 order.

    Null languages, sources and texts are empty strings; repeated rows count again. A group without kept terms still
    has its pairs (value 0 where the language keeps none); a language of one source has no pair. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    named = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counts = store(term_counts(named), "term-counts").df
    kept = store(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms").df
    cells = store(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts").df
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), (F.sum("lang_n") + F.count("*")).alias("lang_total"))
    found = cells.groupBy("lang", "source").agg(F.sum("n").alias("in_source"))
    groups = named.select("lang", "source").distinct().join(langs, "lang", "left").join(found, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "in_source"])
    groups = store(groups.withColumn("total", F.col("in_source") + F.col("terms")).drop("in_source"), "term-groups").df
    pairs = _pairs(cells, kept, groups).withColumn("part", F.lit("pair"))
    shares = cells.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total")), "q": share(F.col("lang_n"), F.col("lang_total"))})
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    best = ranked[1].filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return ranked[0].unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def _pairs(cells: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of sources of a language."""
    # Terms of like counts come into the same block, so that they share columns.
    sized = kept.withColumn("size", F.floor(F.log2("lang_n")).cast("int"))
    parts = sized.groupBy("lang", "size").agg(F.ceil(F.count("*") / TERMS).alias("parts"))
    placed = store(sized.join(parts, ["lang", "size"]).select("lang", "term", "size", F.pmod(F.xxhash64("term"), F.col("parts")).alias("hash")), "term-blocks").df
    blocks = placed.groupBy("lang", "size", "hash").agg(F.count("*").alias("n"))
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("many"))
    dealt = store(groups.join(many, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("many"))), "source-blocks").df
    cells = cells.join(placed, ["lang", "term"]).join(dealt, ["lang", "source"]).select("lang", "source", "size", "hash", "own", "many", "total", "term", "n")
    none = F.lit(None).cast("string").alias("term")
    heads = dealt.join(blocks, "lang", "left").select("lang", "source", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("hash", F.lit(0)).alias("hash"), "own", "many", "total", none, F.coalesce("n", F.lit(0)).alias("n"))
    both = cells.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    both = both.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    priced = both.drop("own", "other", "many").groupBy("lang", "i", "j", "size", "hash").applyInPandas(_price_block, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
