"""The pipeline's stages, each on its own input, and the whole."""

from __future__ import annotations

import importlib
import re
from itertools import takewhile
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as p
from noticeworks.llm import decontam, langid, simhash

from ..conftest import SMALL
from .test_near_copies import grouped, similar_pairs
from .test_near_duplicates import shares
from .test_text_models import plain_mixture

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns(spark, odd):
    docs = odd.select(*COLUMNS)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == COLUMNS and out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_columns_of_any_name_and_type(spark):
    """Every name that the stages' modules use inside, and columns of every kind."""
    modules = [p, *(importlib.import_module(f"noticeworks.llm.{m}") for m in ("langid", "nearcopies", "simhash", "suffixdedup", "decontam", "common"))]
    names = sorted({n for m in modules for n in re.findall(r"[\"']([A-Za-z_]\w*)[\"']", Path(m.__file__).read_text())} - set(COLUMNS) - {"doc_id"})
    kinds = {"m": F.create_map(F.lit("k"), F.lit(1)), "a": F.array(F.lit(1)), "s": F.struct(F.lit(1).alias("text")), "b": F.lit("b").cast("binary"), "d": F.current_date(), "n": F.lit(None).cast("map<string,array<int>>"), "x": F.lit("1.5").cast("decimal(9,2)")}
    text = "a passage of words that goes on for more than a hundred bytes so that it can be found in two of the documents here"
    rows = [(1, text + " and an ending", "en", "a", 1), (1, text + " and an ending", "en", "b", 1), (2, "something else that comes first, and then " + text, "en", "a", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit("x").alias(n) for n in names if n not in kinds), *(c.alias(n) for n, c in kinds.items()))
    assert len(names) > 60
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() > 0
    cut = {r.doc_id: r for r in p.repeated_passages(spark, docs, SMALL).collect()}
    assert len(cut[2].text) < 60 and cut[2].m == {"k": 1}
    assert sorted((r.doc_id, r.source or "") for r in p.near_duplicates(spark, docs, SMALL).collect()) == [(1, "a"), (2, "a"), (3, "")]
    assert p.pack(spark, docs, SMALL).count() == 4


def test_decisions(spark, odd):
    docs = odd.select(*COLUMNS)
    assert {r.doc_id for r in p.language_id(spark, docs, SMALL).collect()}.isdisjoint({1, 2, 3, 4})
    one = p.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r.doc_id or 0 for r in one if r.doc_id != 11) == [0, 1, 4, 5, 6, 8, 10]
    cut = {r.doc_id: r for r in p.repeated_passages(spark, docs, SMALL).collect()}
    assert 9 not in cut and cut[8].n_chars == len(cut[8].text) and cut[1].text is None


def test_rows_that_share_an_id_or_have_none_stay(spark):
    texts = ["one text of some words that nobody else has", "another text with other words and no copy at all", "a third one that is as short as the first two are"]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1), (None, texts[2], "en", "a", 1), (None, texts[1] + " yes", "en", "a", 1), (2, texts[0].upper(), "en", "a", 1), (1, texts[0], "en", "a", 1), (-(1 << 63), "quite different words stand in this last text of all", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in p.near_duplicates(spark, docs, SMALL).collect())
    assert got == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (-(1 << 63), rows[-1][1])])


def test_empty_texts_pass_the_cut(spark):
    long = "a passage of words that goes on for more than a hundred bytes so that it can be found in two of the documents here"
    rows = [(1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, long, "en", "a", 0), (4, long, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in p.repeated_passages(spark, docs, SMALL).collect()} == {1: "", 2: None, 3: long}


def test_whole_pipeline(spark):
    docs = p.table(spark, SMALL, "documents")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.store(stage(spark, docs, SMALL), name).df
        kept[name] = docs.count()
    assert kept["language_id"] > 0.95 * p.table(spark, SMALL, "documents").count()
    groups = simhash.near_duplicates(docs).groupBy("component_id").count().agg({"count": "max"}).first()[0]
    assert groups >= 1 and decontam.find_leaks(docs, p.table(spark, SMALL, "benchmark")).count() == 0
    packed = p.run(spark, SMALL)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def cut_repeats(rows, length=100):
    """Texts without the bytes of strings that start earlier; characters that are cut through stay."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        at = 0
        while at < len(raw):
            size = 1 + sum(1 for _ in takewhile(lambda b: b & 0xC0 == 0x80, raw[at + 1 : at + 4]))
            if not all(gone[at : at + size]):
                gone[at : at + size] = bytes(size)
            at += size
        out[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()
    return out


def test_pipeline_equals_brute_force(spark, corpus):
    """Every stage by its definition, one after the other, over the whole table."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    docs = dict(zip(corpus.doc_id.tolist(), corpus.text.tolist(), strict=True))
    lang = dict(zip(corpus.doc_id.tolist(), corpus.lang.tolist(), strict=True))
    known = [(docs[i], lang[i]) for i in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    model = langid.fit_languages(spark.createDataFrame(known, "text string, lang string"))
    judged = {i: plain_mixture(model, t) if re.search(r"[^\W\d_]", t or "") else None for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if judged[i] and judged[i][1] >= p.LEAST_SHARE}
    ids = sorted(docs)
    near = grouped(ids, similar_pairs(ids, [docs[i] for i in ids]))
    docs = {i: docs[i] for i in ids if near[i] == i}
    docs = {i: t for i, t in cut_repeats(docs.items()).items() if t}
    items = p.table(spark, SMALL, "benchmark").toPandas()
    parts = [decontam.question_answer(t.encode()) for t in items.text]
    docs = {i: t for i, t in docs.items() if not any(min(shares(x, t) for x in part) >= decontam.OVERLAP for part in parts)}
    tokenizer = Tokenizer.from_file(p.tokenizer_path())
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    rows = p.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
