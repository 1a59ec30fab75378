"""Recall by embedding: cosine against categories, best category, threshold and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.text import text


def candidate_text(title: Column, summary: Column, category: Column) -> Column:
    """C16."""
    return F.concat_ws(" ", *(F.nullif(text(c), F.lit("")) for c in (title, summary, category)))


def category_vectors(df: DataFrame, *, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(idx, category, centre): mean vectors of labelled rows; idx numbers the categories in order."""
    parts = df.select(F.col(label).alias("category"), F.posexplode(vector).alias("at", "x")).groupBy("category", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = parts.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"))
    every = centres.agg(F.array_sort(F.collect_set("category")).alias("names"))
    return centres.join(F.broadcast(every)).select((F.array_position("names", F.col("category")) - 1).cast("int").alias("idx"), "category", "centre")


def category_by_index(df: DataFrame, categories: DataFrame, *, idx: str = "idx") -> DataFrame:
    """Rows with the category of their index; null if there is no such index."""
    return df.join(categories.select(F.col("idx").alias(idx), "category"), idx, "left")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def best_category(df: DataFrame, categories: DataFrame, *, row: str, vector: str = "embedding") -> DataFrame:
    """(row, similarity, category): the best of a few categories for each row; the lowest index wins ties.

    The categories stand in one row, as many as a rule pack has, so every row meets all of them without a shuffle."""
    few = categories.agg(F.array_sort(F.collect_list(F.struct("idx", "category", "centre"))).alias("few"))
    scored = df.select(row, vector).join(F.broadcast(few)).select(row, F.transform("few", lambda c: F.struct(cosine(F.col(vector), c["centre"]).alias("similarity"), (-c["idx"]).alias("o"), c["category"].alias("category"))).alias("all"))
    return scored.select(row, F.array_max("all").alias("best")).select(row, "best.similarity", "best.category")


def recall(df: DataFrame, categories: DataFrame, *, row: str, vector: str = "embedding", threshold: float = 0.68, top_k: int = 30) -> DataFrame:
    """Rows whose best similarity reaches the threshold, the best ``top_k`` of them (0: all)."""
    good = best_category(df, categories, row=row, vector=vector).filter(F.col("similarity") >= threshold)
    return good.orderBy(F.desc("similarity"), row).limit(top_k) if top_k > 0 else good
