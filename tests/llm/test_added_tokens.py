"""Packing gives the ids of the tokenizer as its file loads, with added tokens in the text."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from noticeworks.llm import packing, queries

from .test_formats import ODD_TEXTS

TEXTS = [*ODD_TEXTS, "hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n\n b", "x<|endoftext|>y <|endoftext", "<|ENDOFTEXT|>", "<<|endoftext|>>   "]


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_ids(ids):
    encode = packing.encoder(queries.tokenizer_path()).encode_marked
    assert [encode(t).tolist() for t in TEXTS] == ids and 50256 in ids[TEXTS.index("hello <|endoftext|> world")]


def test_pieces(spark, ids):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    for i, own in enumerate(ids):
        own = np.array([*own, packing.END_ID], "<u4")
        pieces = [r for r in rows if r.doc_id == i]
        assert sum(p.length for p in pieces) == len(own)
        assert all(p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes()) for p in pieces)
