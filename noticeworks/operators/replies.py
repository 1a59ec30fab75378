"""Classification by a model outside: prompts go out, replies come in, and rows take them up."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.classify import parse_reply, prompt
from noticeworks.keyed import KeyedTable
from noticeworks.tables import store

#: Columns that a reply fills, by the parsed reply's fields.
FILLED = {"ai_edu_score": "edu_score", "ai_it_score": "it_score", "ai_priority": "priority", "ai_summary": "summary", "ai_reason": "reason"}


def merge_replies(df: DataFrame, replies: DataFrame, *, row: str = "ingest_ord", validation: bool = False) -> DataFrame:
    """Rows with the scores, priority, summary and reason of their reply; suggested tags that a row lacks are
    added in order. ``replies`` has ``row``, reply and, if wanted, model; of several for a row the greatest text counts.
    Rows without a reply keep what they have (null where they have nothing)."""
    model = F.col("model") if "model" in replies.columns else F.lit("")
    one = replies.groupBy(row).agg(F.max(F.struct("reply", model.alias("model"))).alias("_r")).select(row, F.col("_r.model").alias("_model"), parse_reply(F.col("_r.reply"), validation=validation).alias("_reply"))
    joined = df.join(one, row, "left")
    has = F.col("_reply").isNotNull()
    types = {c: "int" if c.endswith("score") else "string" for c in FILLED} | {"ai_model": "string"}
    held = lambda c: F.col(c) if c in df.columns else F.lit(None).cast(types[c])
    new = {c: F.when(has, F.col(f"_reply.{f}")).otherwise(held(c)) for c, f in FILLED.items()} | {"ai_model": F.when(has, F.col("_model")).otherwise(held("ai_model"))}
    none = F.array().cast("array<string>")
    suggested = F.filter(F.coalesce("_reply.suggested_tags", none), lambda t: t.isNotNull())
    new["tags"] = F.concat(F.coalesce("tags", none), F.array_except(suggested, F.coalesce("tags", none)))
    return joined.select(*(F.col(c) for c in df.columns if c not in new), *(v.alias(c) for c, v in new.items()))


REPLIES = "hash string, reply string"
#: Scorers of this Python worker by name: a worker that takes several tasks sets a scorer up once.
_scorers: dict[str, Callable[[list[str]], list[str]]] = {}


def ask(asked: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], held: KeyedTable, *, name: str, row: str = "ingest_ord", size: int = 16, tries: int = 3, wait: float = 1.0, per_round: int = 100_000) -> DataFrame:
    """Between C13 and C14: (row, reply) of the prompts in ``asked`` (row, prompt) that have a reply.

    ``make`` sets up a scorer, once for each Python worker and ``name``; it takes ``size`` prompts and gives as many
    replies. Equal prompts are asked once. Replies are kept in ``held`` (columns REPLIES, key hash) by the prompt's hash,
    a round of ``per_round`` prompts at a time: what an earlier call or an earlier round was told is not asked again, and
    a task that is lost repeats its part of one round. Prompts that fail ``tries`` times, ``wait`` seconds apart and
    longer each time, have no reply and are asked by the next call. Null prompts are not asked."""
    hashed = asked.select(row, "prompt", F.sha2(F.col("prompt").cast("binary"), 256).alias("hash")).filter("prompt is not null")
    prompts = hashed.select("hash", "prompt").dropDuplicates(["hash"])
    missing = store(prompts.join(held.lookup(prompts.select("hash")).select("hash"), "hash", "left_anti"), "prompts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if name not in _scorers:
                _scorers[name] = make()
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                told = _replies(_scorers[name], some.column("prompt").to_pylist(), tries, wait)
                yield pa.RecordBatch.from_arrays([some.column("hash"), pa.array(told, pa.string())], ["hash", "reply"])

    rounds = math.ceil(missing.df.count() / per_round)
    for i in range(rounds):
        part = missing.df.filter(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == i)
        told = store(part.mapInArrow(run, REPLIES).filter("reply is not null"), "replies")  # the table's write sorts it, which must ask nothing again
        held.write(told.df)
        told.drop()
    missing.drop()
    return hashed.join(held.lookup(hashed.select("hash")), "hash").select(row, "reply")


def _replies(score: Callable[[list[str]], list[str]], prompts: list[str], tries: int, wait: float) -> list[str | None]:
    for i in range(tries):
        try:
            told = score(prompts)
            if len(told) == len(prompts):
                return told
        except Exception:  # noqa: BLE001  a scorer may fail in any way of its own
            pass
        if i + 1 < tries:
            time.sleep(wait * 2**i)
    return [None] * len(prompts)


def classify(df: DataFrame, template: str, score: Callable[[DataFrame], DataFrame], *, fields: tuple[str, ...] = ("title", "organization", "summary"), row: str = "ingest_ord", validation: bool = False) -> DataFrame:
    """``score`` takes (row, prompt) and gives (row, reply); its replies are merged into the rows."""
    asked = df.select(row, prompt(template, **{f: F.col(f) for f in fields}).alias("prompt"))
    return merge_replies(df, score(asked), row=row, validation=validation)
