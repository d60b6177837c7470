"""The evaluation report: what each query's events found, summaries by mode and group, and comparisons of modes.

Everything up to the summaries is a plan; :func:`summary_document` collects one row for each group, :func:`write_events` and
:func:`write_report` write rows as they are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import evaluate
from tidepool.operators.scoring import Scorer, score
from tidepool.plans.store import _path

RELEVANT = ("development", "holdout")
GROUPS = ("split", "language", "category", "tag")
_MEASURES = ("hit_at_5", "mrr_at_10", "ndcg_at_10")


def select_queries(queries: DataFrame, splits: list[str] | None = None, languages: list[str] | None = None, query_type: str | None = None) -> DataFrame:
    """Queries of the splits, languages and type asked for; all where nothing is."""
    for column, wanted in (("split", splits), ("language", languages), ("query_type", [query_type] if query_type else None)):
        if wanted:
            queries = queries.where(F.col(column).isin(*wanted))
    return queries


def labels_of(queries: DataFrame) -> DataFrame:
    """(query_id, evidence_id, path, start_byte, end_byte, relevance) of definitions."""
    rows = queries.select(F.col("id").alias("query_id"), F.explode("labels").alias("x"))
    return rows.select("query_id", *[F.col(f"x.{c}").alias(c) for c in ("evidence_id", "path", "start_byte", "end_byte", "relevance")])


def spans_of(events: DataFrame, field: str) -> DataFrame:
    """(query_id, mode, path, start_byte, end_byte[, rank, score]) of one of the events' lists of spans."""
    rows = events.select("query_id", "mode", F.explode(field).alias("x"))
    extra = ("rank", "score") if field == "results" else ()
    return rows.select("query_id", "mode", *[F.col(f"x.{c}").alias(c) for c in ("path", "start_byte", "end_byte", *extra)])


def per_query(queries: DataFrame, events: DataFrame) -> DataFrame:
    """One row per (query_id, mode) that has an event: metrics, coverability, and for fast what the candidates held."""
    labels, results = labels_of(queries), spans_of(events, "results")
    own = queries.select(F.col("id").alias("query_id"), "intent_id", "split", "category", "language", "tags")
    first = F.min_by(F.struct(F.col("x.score").alias("s")), F.col("x.rank"))["s"]
    seen = events.join(own, "query_id", "left_semi").select("query_id", "mode", F.explode_outer("results").alias("x")).groupBy("query_id", "mode").agg(
        F.count("x").alias("result_count"), first.alias("top_score")
    )
    out = seen.join(own, "query_id")
    measured = evaluate.metrics(own, labels, results).select("query_id", "mode", *_MEASURES)
    out = out.join(measured, ["query_id", "mode"], "left")
    out = out.withColumns({"hit_at_5": F.coalesce("hit_at_5", F.lit(False)), "mrr_at_10": F.coalesce("mrr_at_10", F.lit(0.0)), "ndcg_at_10": F.coalesce("ndcg_at_10", F.lit(0.0))})
    covered = evaluate.coverability(labels, spans_of(events, "all_chunk_spans")).select("query_id", "mode", "gold_coverability", F.col("uncoverable").alias("uncoverable_evidence_ids"))
    recall = evaluate.candidate_recall(labels, spans_of(events, "all_chunk_spans"), spans_of(events, "candidate_spans")).where("mode = 'fast'")
    recall = recall.select("query_id", "mode", "candidate_evidence_recall", "candidate_recall_given_coverable", "candidate_hit")
    asked = events.where("mode = 'fast'").select("query_id", "mode", F.size("candidate_spans").alias("candidate_count"), "candidate_limit")
    for part in (covered, recall, asked):
        out = out.join(part, ["query_id", "mode"], "left")
    return out


def _summary(rows: DataFrame, by: list[str]) -> DataFrame:
    relevant = F.col("split").isin(*RELEVANT)
    of = lambda x: F.avg(F.when(relevant, F.col(x).cast("double")))
    fast = relevant & (F.col("mode") == "fast")
    given = F.when(fast, F.col("candidate_recall_given_coverable"))
    size = F.when(fast, F.col("candidate_count"))
    return rows.groupBy(*by, "mode").agg(
        F.count_if(relevant).alias("query_count"), *[of(c).alias(c) for c in _MEASURES], F.avg(F.when(fast, F.col("candidate_evidence_recall"))).alias("evidence_recall_macro"),
        F.count(given).alias("representable_query_count"), F.avg(given).alias("recall_given_coverable_macro"), F.avg(F.when(fast, F.col("candidate_hit").cast("double"))).alias("hit_rate"),
        F.min(size).alias("candidates_min"), F.percentile(size, 0.5).alias("candidates_median"), F.percentile(size, 0.95).alias("candidates_p95"), F.max(size).alias("candidates_max"),
    )


def summaries(rows: DataFrame) -> DataFrame:
    """(dimension, value, mode, ...) of all rows and of each split, language, category and tag, in this order."""
    parts = [_summary(rows, []).select(F.lit("all").alias("dimension"), F.lit("").alias("value"), "*")]
    for name in GROUPS:
        given = rows.withColumn("tag", F.explode("tags")) if name == "tag" else rows
        parts.append(_summary(given, [name]).select(F.lit(name).alias("dimension"), F.col(name).alias("value"), *parts[0].columns[2:]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("dimension", "value", "mode")


def compare_modes(rows: DataFrame, results: DataFrame, a: str = "fast", b: str = "deep") -> DataFrame:
    """One row: pairs of events of relevant queries, and the means of their top ten's Jaccard and intersection and of b's hits less a's."""
    pairs = evaluate.mode_overlap(results, rows.where(F.col("split").isin(*RELEVANT)), a, b)
    return pairs.agg(
        F.count("*").alias("query_pair_count"), F.avg("jaccard").alias("top10_jaccard_mean"), F.avg("intersection").alias("top10_intersection_mean"),
        F.avg(-F.col("hit_delta")).alias(f"{b}_minus_{a}_hit_at_5"),
    )


def irrelevant_scores(rows: DataFrame) -> DataFrame:
    """By mode, the best results' scores of queries that have no answer."""
    return evaluate.quantiles(rows.where("split = 'irrelevant'"), "top_score", ["mode"]).orderBy("mode")


def summary_document(queries: DataFrame, events: DataFrame, splits: list[str]) -> dict:
    """The summary as a document; it grows with the number of groups, not of queries, which :func:`per_query` has."""
    asked = select_queries(queries, splits)
    rows = per_query(asked, events)
    out = {"schema_version": 1, "record_type": "evaluation_summary", "selected_splits": sorted(splits), "modes": {}, "groups": {f"by_{g}": {} for g in GROUPS}}
    for r in summaries(rows).collect():
        held = {"query_count": r.query_count} | {c: r[c] for c in _MEASURES}
        if r.mode == "fast":
            held["candidate_coverage"] = {c: r[c] for c in ("evidence_recall_macro", "representable_query_count", "recall_given_coverable_macro", "hit_rate")} | {
                "candidate_count": {c: r[f"candidates_{c}"] for c in ("min", "median", "p95", "max")}
            }
        place = out["modes"] if r.dimension == "all" else out["groups"][f"by_{r.dimension}"].setdefault(r.value, {})
        place[r.mode] = held
    out["fast_deep_comparison"] = compare_modes(rows, spans_of(events, "results")).first().asDict()
    out["irrelevant_score_distribution"] = {r["mode"]: {k: r[k] for k in ("n", "lo", "median", "p95", "hi")} for r in irrelevant_scores(rows).collect()}
    return out


def write_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines; what is there already is never overwritten. Lexical events have no candidate limit."""
    limit = F.when(F.col("mode") != "lexical", F.col("candidate_limit"))
    out = events.withColumn("candidate_limit", limit).withColumns({"schema_version": F.lit(1), "record_type": F.lit("evaluation_result")})
    out.write.mode("errorifexists").json(path)


def write_document(spark, document: dict, path: str, overwrite: bool = False) -> None:
    """A document as JSON with sorted keys, at any path that Spark reads; an existing file is an error unless told otherwise."""
    jpath, system = _path(spark, path)
    stream = system.create(jpath, overwrite)
    try:
        stream.write(bytearray((json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    finally:
        stream.close()


def write_report(queries: DataFrame, events: DataFrame, splits: list[str], folder: str) -> dict:
    """``summary.json`` and the rows ``per_query`` in a new folder."""
    document = summary_document(queries, events, splits)
    per_query(select_queries(queries, splits), events).write.mode("errorifexists").json(f"{folder}/per_query")
    write_document(queries.sparkSession, document, f"{folder}/summary.json")
    return document


# Evidence pool -------------------------------------------------------------------------------------------------------
def evidence_pool(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """The distinct judged spans of positive relevance of all queries, with their text: (chunk_index, path, start_byte, end_byte, passage)."""
    spans = labels_of(queries).where("relevance > 0").groupBy("path", "start_byte", "end_byte").agg(F.min("evidence_id").alias("evidence_id"))
    text = F.decode(F.substring(F.encode("text", "UTF-8"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    out = spans.join(sources.select("path", "text"), "path").select("evidence_id", "path", "start_byte", "end_byte", text.alias("passage"))
    return out.withColumn("chunk_index", F.xxhash64("path", "start_byte", "end_byte"))


def rerank_pool(queries: DataFrame, pool: DataFrame, scorer: Scorer | None = None, score_column=None, batch_size: int = 1, most: int = 10) -> DataFrame:
    """Each query's best ``most`` spans of the pool: (query_id, rank, evidence_id, path, start_byte, end_byte, score, relevant).

    Queries are the stated set here, judged spans the pool: each scores all spans, one query at a time with a model, and keeps its best.
    """
    relevant = labels_of(queries).where("relevance > 0").select("query_id", "path", "start_byte", "end_byte", F.lit(True).alias("relevant")).distinct()
    parts = []
    for q in queries.select("id", "query").collect():
        if score_column is not None:
            scored = pool.withColumn("score", score_column(q["query"], F.col("passage")))
        else:
            scored = pool.join(score(pool, q["query"], scorer, batch_size), "chunk_index").withColumnRenamed("relevance_logit", "score")
        order = [F.desc("score"), F.asc("path"), F.asc("start_byte"), F.asc("end_byte")]
        best = scored.orderBy(*order).limit(most).groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "path", "start_byte", "end_byte", "evidence_id", "score"))).alias("xs"))
        parts.append(best.select(F.lit(q["id"]).alias("query_id"), F.posexplode("xs").alias("k", "x")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.select("query_id", (F.col("k") + 1).alias("rank"), *[F.col(f"x.{c}").alias(c) for c in ("evidence_id", "path", "start_byte", "end_byte", "score")])
    return out.join(relevant, ["query_id", "path", "start_byte", "end_byte"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def pool_metrics(queries: DataFrame, ranked: DataFrame, tags: tuple[str, ...] = ("korean_to_english",)) -> DataFrame:
    """(group, query_count, hit_at_5, mrr_at_10) of all queries, of each language and of the tags."""
    found = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    rows = queries.select(F.col("id").alias("query_id"), "language", "tags").join(found, "query_id", "left")
    tagged = F.transform(F.array_intersect("tags", F.array(*[F.lit(t) for t in tags])), lambda t: F.concat(F.lit("tag:"), t))
    rows = rows.withColumn("group", F.explode(F.concat(F.array(F.lit("all"), F.concat(F.lit("language:"), "language")), tagged)))
    hit: Column = F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0))
    reciprocal = F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)
    return rows.groupBy("group").agg(F.count("*").alias("query_count"), F.avg(hit).alias("hit_at_5"), F.avg(reciprocal).alias("mrr_at_10")).orderBy("group")
