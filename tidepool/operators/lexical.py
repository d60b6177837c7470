"""Query-local BM25 over body and path terms.

A chunk is reduced, in its scan, to the counts of the query's terms and its lengths: no term is exploded or shuffled. One
aggregation gives document frequencies, the number of chunks and total lengths (one row), and scores are a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import query_terms, terms
from tidepool.plans.store import written

K1, B = 1.2, 0.75


def counts(chunks: DataFrame, query: list[str], text_col: str = "passage", path_col: str = "path", normalize: bool = True) -> DataFrame:
    """``chunks`` without text, with b0.., p0.. (counts of the query's terms in body and path), b_len and p_len."""
    out = chunks.withColumn("__b", terms(F.col(text_col), normalize)).withColumn("__p", terms(F.col(path_col), normalize))
    found = [_occurrences(f"__{s}", t).alias(f"{s}{k}") for s in "bp" for k, t in enumerate(query)]
    keep = [c for c in chunks.columns if c != text_col]
    return out.select(*keep, *found, F.size("__b").cast("long").alias("b_len"), F.size("__p").cast("long").alias("p_len"))


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term)).cast("long")


def statistics(counted: DataFrame, n_terms: int) -> DataFrame:
    """One row: n, b_total, p_total, and document frequencies db0.., dp0.."""
    found = [F.coalesce(F.sum((F.col(f"{s}{k}") > 0).cast("long")), F.lit(0)).alias(f"d{s}{k}") for s in "bp" for k in range(n_terms)]
    return counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("b_len"), F.lit(0)).alias("b_total"), F.coalesce(F.sum("p_len"), F.lit(0)).alias("p_total"), *found)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(side: str, n_terms: int) -> Column:
    """The score of a side; 0 when the average length is 0."""
    average = F.col(f"{side}_total") / F.col("n")
    total = F.lit(0.0)
    for k in range(n_terms):
        tf = F.col(f"{side}{k}")
        norm = tf + K1 * (1 - B + B * F.col(f"{side}_len") / average)
        total = total + F.when(tf > 0, idf(F.col("n"), F.col(f"d{side}{k}")) * tf * (K1 + 1) / norm).otherwise(0.0)
    return F.when(F.col(f"{side}_total") > 0, total).otherwise(0.0)


def score(chunks: DataFrame, query: str, text_col: str = "passage", path_col: str = "path", digits: int | None = None, normalize: bool = True, keep_all: bool = False) -> DataFrame:
    """``chunks`` without text, with body_score, path_score and score; only positive scores unless ``keep_all``."""
    asked = query_terms(query)
    counted = written(counts(chunks, asked, text_col, path_col, normalize))
    out = counted.crossJoin(F.broadcast(statistics(counted, len(asked))))  # one row
    body, path = bm25("b", len(asked)), bm25("p", len(asked))
    if digits is not None:
        body, path = F.round(body, digits), F.round(path, digits)
    out = out.withColumn("body_score", body).withColumn("path_score", path).withColumn("score", F.col("body_score") + F.col("path_score"))
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    keep = [c for c in chunks.columns if c != text_col]
    out = out.select(*keep, "body_score", "path_score", "score")
    return out if keep_all else out.where("score > 0")


def result_order() -> list[Column]:
    return [F.desc("score"), F.split("path", "/").asc(), F.asc("start_byte"), F.asc("end_byte"), F.asc("source_id"), F.asc("chunk_index")]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(*result_order()).limit(k)


def ranking_order() -> list[Column]:
    return [F.desc("score"), F.desc("body_score"), F.desc("path_score"), F.asc("chunk_index")]
