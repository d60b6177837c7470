"""Retrieval evaluation: ranked spans against labelled evidence, on joins, windows and aggregations.

Tables: ``queries`` (query_id, intent_id, split, category, language, tags), ``labels`` (query_id, evidence_id, path,
start_byte, end_byte, relevance), ``spans`` (query_id, mode, path, start_byte, end_byte[, rank, score]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.text import coverage, dcg_term
from tidepool.operators.contracts import ContractError

LEAST_COVERAGE = 0.5


def evidence_hits(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """Spans joined to labels of positive relevance, in the same path, that they cover by half at least."""
    s, t = spans.alias("s"), labels.where("relevance > 0").alias("t")
    same = (F.col("s.query_id") == F.col("t.query_id")) & (F.col("s.path") == F.col("t.path"))
    apart = (F.col("s.start_byte") < F.col("t.end_byte")) & (F.col("s.end_byte") > F.col("t.start_byte"))
    covered = coverage(F.col("t.start_byte"), F.col("t.end_byte"), F.col("s.start_byte"), F.col("s.end_byte"))
    return s.join(t, same & apart).where(covered >= LEAST_COVERAGE).select("s.*", "t.evidence_id", "t.relevance", covered.alias("coverage"))


def metrics(queries: DataFrame, labels: DataFrame, results: DataFrame) -> DataFrame:
    """hit_at_5, mrr_at_10 and ndcg_at_10 of each (query_id, mode); a label counts at its first rank only."""
    first = Window.partitionBy("query_id", "mode", "evidence_id").orderBy("rank")
    unseen = evidence_hits(results, labels).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    by_rank = unseen.groupBy("query_id", "mode", "rank").agg(F.max("relevance").alias("relevance"))
    found = by_rank.groupBy("query_id", "mode").agg(
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("rank") <= 10, dcg_term(F.col("relevance"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "evidence_id")
    ideal = labels.where("relevance > 0").withColumn("__r", F.row_number().over(place)).where("__r <= 10")
    ideal = ideal.groupBy("query_id").agg(F.sum(dcg_term(F.col("relevance"), F.col("__r"))).alias("ideal"))
    events = results.select("query_id", "mode").distinct().join(queries, "query_id")
    out = events.join(found, ["query_id", "mode"], "left").join(ideal, "query_id", "left")
    return out.select(
        *events.columns,
        F.coalesce(F.col("first_rank") <= 5, F.lit(False)).alias("hit_at_5"),
        F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr_at_10"),
        F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg_at_10"),
    )


def summary(measured: DataFrame, dimensions: list[str]) -> DataFrame:
    """Macro means of :func:`metrics` for all rows and for each dimension with the mode, in one pass of grouping sets."""
    sets = [["mode"], *[[d, "mode"] for d in dimensions]]
    out = measured.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*dimensions, "mode")]).agg(
        F.count("*").alias("queries"), F.avg(F.col("hit_at_5").cast("double")).alias("hit_at_5"), F.avg("mrr_at_10").alias("mrr_at_10"), F.avg("ndcg_at_10").alias("ndcg_at_10")
    )
    return out


def tag_summary(measured: DataFrame) -> DataFrame:
    return measured.select("*", F.explode("tags").alias("tag")).groupBy("tag", "mode").agg(
        F.count("*").alias("queries"), F.avg(F.col("hit_at_5").cast("double")).alias("hit_at_5"), F.avg("mrr_at_10").alias("mrr_at_10"), F.avg("ndcg_at_10").alias("ndcg_at_10")
    )


def coverability(labels: DataFrame, all_spans: DataFrame) -> DataFrame:
    """By (query_id, mode): gold_coverability and the ids that no span covers."""
    held = labels.where("relevance > 0").select("query_id", "evidence_id").distinct()
    modes = all_spans.select("query_id", "mode").distinct()
    hit = evidence_hits(all_spans, labels).select("query_id", "mode", "evidence_id").distinct().withColumn("covered", F.lit(True))
    rows = modes.join(held, "query_id").join(hit, ["query_id", "mode", "evidence_id"], "left")
    return rows.groupBy("query_id", "mode").agg(
        F.count("*").alias("labels"), F.count("covered").alias("coverable"), (F.count("covered") / F.count("*")).alias("gold_coverability"),
        F.array_sort(F.collect_list(F.when(F.col("covered").isNull(), F.col("evidence_id")))).alias("uncoverable"),
    )


def candidate_recall(labels: DataFrame, all_spans: DataFrame, candidate_spans: DataFrame) -> DataFrame:
    """By (query_id, mode): recall of candidates over all labels and over those that some span covers."""
    every = coverability(labels, all_spans)
    hit = evidence_hits(candidate_spans, labels).groupBy("query_id", "mode").agg(F.countDistinct("evidence_id").alias("hits"))
    out = every.join(hit, ["query_id", "mode"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select(
        "query_id", "mode", "labels", "coverable", "hits", (F.col("hits") / F.col("labels")).alias("candidate_evidence_recall"),
        (F.col("hits") / F.nullif(F.col("coverable"), F.lit(0))).alias("candidate_recall_given_coverable"), (F.col("hits") > 0).alias("candidate_hit"),
    )


def mode_overlap(results: DataFrame, measured: DataFrame, a: str = "fast", b: str = "deep", k: int = 10) -> DataFrame:
    """By query: Jaccard and intersection of two modes' top-k spans (two empty sets: 1) and the difference of hits."""
    def side(mode: str):
        top = results.where((F.col("mode") == mode) & (F.col("rank") <= k)).groupBy("query_id").agg(F.collect_set(F.struct("path", "start_byte", "end_byte")).alias(f"s_{mode}"))
        return measured.where(F.col("mode") == mode).select("query_id", F.col("hit_at_5").cast("int").alias(f"h_{mode}")).join(top, "query_id", "left")

    both = side(a).join(side(b), "query_id")
    empty = F.expr("CAST(array() AS array<struct<path:string,start_byte:bigint,end_byte:bigint>>)")
    x, y = F.coalesce(f"s_{a}", empty), F.coalesce(f"s_{b}", empty)
    shared, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return both.select("query_id", shared.alias("intersection"), F.when(union > 0, shared / union).otherwise(1.0).alias("jaccard"), (F.col(f"h_{a}") - F.col(f"h_{b}")).alias("hit_delta"))


def quantiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, min, median, p95 (interpolated), nearest-rank p95, and max."""
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95_nearest"), F.max(value).alias("hi"),
    )


def benchmark_summary(runs: DataFrame, values: list[str]) -> DataFrame:
    """Steady-state quantiles (without run 1) of each measure of benchmark runs."""
    long = runs.where("run > 1").unpivot(["run"], values, "measure", "ms")
    return quantiles(long, "ms", ["measure"])


def missing_events(queries: DataFrame, modes: list[str], events: DataFrame) -> DataFrame:
    """Required (query, mode) that have no event."""
    required = queries.select("query_id", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    return required.join(events.select("query_id", "mode").distinct(), ["query_id", "mode"], "left_anti")


def unknown_events(queries: DataFrame, events: DataFrame) -> DataFrame:
    return events.join(queries, "query_id", "left_anti")


def inventory_difference(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): listed and missing, found and unlisted, or of another digest."""
    both = listed.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("have"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def read_jsonl(spark, path: str, schema) -> DataFrame:
    """Rows of a JSON-lines file; a bad line or an empty file is an error, blank lines are not."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not rows.take(1):
        raise ContractError(f"{path} has no rows")
    return rows
