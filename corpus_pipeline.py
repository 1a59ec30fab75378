"""The corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import decontam, langid, packing, simhash, suffixdedup
from noticeworks.llm.common import fold, store
from noticeworks.llm.queries import table, tokenizer_path

#: A document whose main language has less than this share is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a main language; texts that are null or hold no letter go, and so do even mixtures."""
    model = langid.fit_languages(docs.filter(fold(F.col("doc_id"), 3) != 1).select("text", "lang"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no column is called like a result
    named = dict(zip(docs.columns, plain.columns, strict=True))
    marked = langid.predict_languages(plain, model, id_col=named["doc_id"], text_col=named["text"], keep=[c for c in plain.columns if c != named["doc_id"]])
    return marked.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*(F.col(n).alias(c) for c, n in named.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of least id.
    Pairs are found by SimHash and pivot distance tables and verified exactly.
    Texts that are null, empty or without words are copies of each other. See ``one_of_each`` for ids that are null or
    shared and for repeated rows."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages; documents of which the cut leaves nothing go. n_chars follows the text. Null and empty
    texts stay as they are; repeated rows are cut alike."""
    plain = F.coalesce(F.length("text"), F.lit(0)) == 0
    cut = suffixdedup.remove_repeats(docs.filter(~plain)).filter("text <> ''").withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns).unionByName(docs.filter(plain))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go. Texts without a word repeat none; rows that share an id go together."""
    leaks = store(decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks").df
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["doc_id"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows: a row for each piece. Null texts are empty; repeated rows are packed as often."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", pack)]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = store(stage(spark, docs, sf_dir), name)
        if last:
            last.drop()
        docs, last = kept.df, kept
    return docs
