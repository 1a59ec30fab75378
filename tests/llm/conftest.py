from __future__ import annotations

import pandas as pd
import pytest

from ..conftest import SMALL

#: Columns whose names the operators use inside.
CLASHES = ("fp", "id", "tid", "score", "host", "key", "data", "spans", "frag", "gram", "value", "_tid", "found_spans", "span_id", "row", "c0", "c1")


@pytest.fixture(scope="session")
def corpus():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns of clashing names."""
    long = " ".join(f"word{i % 977} plus{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "12345 !!! ---"), (5, "one"), (5, "one"), (6, "one two three four five six"), (7, "one two three four five six"), (8, long), (None, "a text without an id, but with words enough to be read"), (9, long), (10, "Ünïcödé — “quotes” 漢字 " * 9), (11, "\0 nul \0")]
    df = spark.createDataFrame([(i, t, "en" if t else None, None, None, *("x",) * len(CLASHES)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
