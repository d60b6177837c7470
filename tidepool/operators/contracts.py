"""Referential and definition checks as queries: each gives the rows that break a rule, with the rule's name, and none if all is well.

A problem table has ``problem`` and ``subject`` (what breaks it). :func:`require` turns one into an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.sources.tables import byte_to_line, line_starts

#: What query definitions and events may hold.
SPLITS = ("development", "holdout", "irrelevant")
LANGUAGES = ("en", "ko")
MODES = ("lexical", "fast", "deep")
SCHEMA_VERSION = 1
_HEX = "^[0-9a-f]{64}$"


class ContractError(ValueError):
    """Input breaks its contract."""


def require(problems: DataFrame, message: str) -> None:
    """Raises when there is a problem; shows a few of them."""
    rows = problems.take(5)
    if rows:
        raise ContractError(f"{message}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in rows))


def _broken(df: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a rule that is null is broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items()]))
    return df.select(subject.cast("string").alias("subject"), F.explode(found).alias("problem")).select("problem", "subject")


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str], problem: str) -> DataFrame:
    """Keys that come up more than once."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit(problem).alias("problem"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("subject"))


def filled(column: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(column))) > 0, F.lit(False))


def relative_path(path: Column) -> Column:
    """Relative, with no empty, ``.`` or ``..`` part and no backslash."""
    parts = F.split(path, "/")
    return (F.length(path) > 0) & ~F.contains(path, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


# Sources and chunks --------------------------------------------------------------------------------------------------
def source_problems(sources: DataFrame) -> DataFrame:
    """Source ids that are missing or come up twice."""
    return _all([_broken(sources, F.col("path"), {"missing_source_id": F.col("source_id").isNotNull()}), duplicates(sources, ["source_id"], "duplicate_source_id")])


def chunk_problems(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of no source, with an empty or invalid range of bytes, or with lines that aren't those of the bytes."""
    text = F.encode("__text", "UTF-8")
    size = F.octet_length("__text")
    a, b = F.col("start_byte"), F.col("end_byte")
    # a range is valid where it begins and ends between characters: not before a continuation byte
    between = lambda at: (at == size) | ((F.conv(F.hex(F.substring(text, (at + 1).cast("int"), 1)), 16, 10).cast("int").bitwiseAND(0xC0)) != 0x80)
    starts = line_starts(F.col("__text"))
    known = sources.select("source_id", F.coalesce("text", F.lit("")).alias("__text"), F.lit(True).alias("__known"))
    rows = chunks.select("source_id", "start_byte", "end_byte", "start_line", "end_line").join(known, "source_id", "left").withColumn("__starts", starts)
    subject = F.concat_ws(":", F.col("source_id").cast("string"), a.cast("string"), b.cast("string"))
    ours = F.col("__known").isNotNull()
    whole = ours & (a >= 0) & (a <= b) & (b <= size)
    rules = {
        "unknown_source": ours,
        "invalid_range": ~ours | F.coalesce(whole & between(a) & between(b), F.lit(False)),
        "empty_range": ~ours | (a != b),
        "wrong_lines": ~whole | (a == b) | ((byte_to_line(F.col("__starts"), a, size) == F.col("start_line")) & (byte_to_line(F.col("__starts"), b - 1, size) == F.col("end_line"))),
    }
    return _all([source_problems(sources), _broken(rows, subject, rules)])


def index_problems(chunks: DataFrame) -> DataFrame:
    """Chunk indexes that come up twice."""
    return duplicates(chunks, ["chunk_index"], "duplicate_chunk_index")


# Evaluation definitions ----------------------------------------------------------------------------------------------
def query_problems(queries: DataFrame) -> DataFrame:
    """Definitions (id, intent_id, split, category, language, query_type, query, tags, labels[, schema_version, record_type])."""
    irrelevant = F.col("query_type") == "irrelevant"
    rules = {
        **{f"missing_{c}": filled(c) for c in ("id", "intent_id", "split", "category", "language", "query")},
        "unknown_split": F.col("split").isin(*SPLITS),
        "unknown_language": F.col("language").isin(*LANGUAGES),
        "unknown_query_type": F.col("query_type").isin("relevant", "irrelevant"),
        "irrelevant_split": irrelevant == (F.col("split") == "irrelevant"),
        "bad_tags": F.col("tags").isNotNull() & ~F.exists("tags", lambda t: t.isNull() | (t == "")),
        "labels_of_type": F.when(irrelevant, F.size("labels") == 0).otherwise(F.size("labels") > 0),
        "duplicate_evidence": F.size(F.array_distinct(F.col("labels.evidence_id"))) == F.size("labels"),
    }
    if "schema_version" in queries.columns:
        rules["schema_version"] = F.col("schema_version") == SCHEMA_VERSION
    if "record_type" in queries.columns:
        rules["record_type"] = F.col("record_type") == "query"
    return _all([_broken(queries, F.col("id"), rules), duplicates(queries, ["id"], "duplicate_query_id")])


#: What makes two labels the same.
SIGNATURE = ("evidence_id", "path", "start_byte", "end_byte", "start_line", "end_line", "relevance")


def label_signature(labels: Column) -> Column:
    """The labels of a query, without their rationale, in order."""
    return F.array_sort(F.transform(labels, lambda x: F.struct(*[x[c].alias(c) for c in SIGNATURE])))


def intent_problems(queries: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Intents without exactly one variant in each language, or whose variants differ in split, category, type or labels."""
    found = queries.withColumn("__labels", label_signature(F.col("labels"))).groupBy("intent_id").agg(
        F.array_sort(F.collect_list("language")).alias("spoken"), *[F.count_distinct(c).alias(f"n_{c}") for c in ("split", "category", "query_type")],
        F.size(F.collect_set("__labels")).alias("n_labels"),
    )
    rules = {"intent_languages": F.col("spoken") == F.array(*[F.lit(x) for x in sorted(languages)])}
    rules |= {f"intent_{c}": F.col(f"n_{c}") == 1 for c in ("split", "category", "query_type", "labels")}
    return _broken(found, F.col("intent_id"), rules)


def label_problems(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """Labels (query_id, evidence_id, path, start_byte, end_byte, start_line, end_line, relevance[, rationale]) outside their file, blank,
    with other lines than their bytes', or with a relevance that isn't 0, 1 or 2."""
    files = sources.select("path", F.coalesce("text", F.lit("")).alias("__text"), F.lit(True).alias("__known"))
    rows = labels.join(files, "path", "left").withColumn("__starts", line_starts(F.col("__text"))).withColumn("__size", F.octet_length("__text"))
    a, b, size = F.col("start_byte"), F.col("end_byte"), F.col("__size")
    inside = (a >= 0) & (a < b) & (b <= size)
    known = F.col("__known").isNotNull()
    text = F.decode(F.substring(F.encode("__text", "UTF-8"), (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    rules = {
        "bad_path": relative_path(F.col("path")), "unknown_path": known, "outside_file": ~known | inside,
        "blank_evidence": ~known | ~inside | F.coalesce(text.rlike(r"\S"), F.lit(False)),
        "wrong_lines": ~known | ~inside | ((byte_to_line(F.col("__starts"), a, size) == F.col("start_line")) & (byte_to_line(F.col("__starts"), b - 1, size) == F.col("end_line"))),
        "bad_relevance": F.col("relevance").between(0, 2), "missing_evidence_id": filled("evidence_id"),
    }
    if "rationale" in labels.columns:
        rules["missing_rationale"] = filled("rationale")
    return _broken(rows, F.concat_ws(":", "query_id", "evidence_id"), rules)


def manifest_problems(inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """An inventory (path, sha256): bad paths or digests, paths that are listed twice, missing, changed, or not listed."""
    digest = sources.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__have"))
    rules = {"bad_path": relative_path(F.col("path")), "bad_digest": F.col("sha256").rlike(_HEX)}
    both = inventory.select("path", "sha256").join(digest, "path", "full")
    state = F.when(F.col("__have").isNull(), "missing_file").when(F.col("sha256").isNull(), "unlisted_file").when(F.col("sha256") != F.col("__have"), "changed_file")
    differ = both.select(state.alias("problem"), F.col("path").alias("subject")).where("problem IS NOT NULL")
    return _all([_broken(inventory, F.col("path"), rules), duplicates(inventory, ["path"], "listed_twice"), differ])


def count_problems(queries: DataFrame, expected: dict[tuple[str, str], int]) -> DataFrame:
    """Numbers of intents by (split, category) that aren't those of a manifest."""
    spark = queries.sparkSession
    want = spark.createDataFrame([(s, c, n) for (s, c), n in expected.items()], "split string, category string, want long")
    have = queries.groupBy("split", "category").agg(F.count_distinct("intent_id").alias("have"))
    both = want.join(have, ["split", "category"], "full").where(~F.coalesce("want", F.lit(0)).eqNullSafe(F.coalesce("have", F.lit(0))))
    return both.select(F.lit("intent_count").alias("problem"), F.concat_ws(":", "split", "category", F.col("want").cast("string"), F.col("have").cast("string")).alias("subject"))


def low_overlap_problems(queries: DataFrame, listed: list[str], least: int = 12, tag: str = "low_lexical_overlap") -> DataFrame:
    """Listed intents that are unknown or of which a variant lacks the tag, and a list that is too short."""
    spark = queries.sparkSession
    names = spark.createDataFrame([(x,) for x in sorted(set(listed))], "intent_id string")
    tagged = queries.groupBy("intent_id").agg(F.min(F.array_contains("tags", tag).cast("int")).alias("tagged"))
    rows = names.join(tagged, "intent_id", "left")
    few = spark.createDataFrame([("too_few_low_overlap_intents", str(len(set(listed))))] * (len(set(listed)) < least), "problem string, subject string")
    rules = {"unknown_intent": F.col("tagged").isNotNull(), "missing_tag": F.col("tagged").isNull() | (F.col("tagged") == 1)}
    return _all([_broken(rows, F.col("intent_id"), rules), few])


# Events --------------------------------------------------------------------------------------------------------------
def span_keys(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["path"].alias("path"), s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte")))


def event_problems(events: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Events (query_id, mode, chunk_contract_id, all_chunk_spans, candidate_spans, evaluated_spans, results, scoring_complete,
    candidate_limit) against queries (id) and files: modes, ranks, scores, spans, and what each mode has to cover."""
    e = events.withColumn("__all", span_keys(F.col("all_chunk_spans"))).withColumn("__cand", span_keys(F.col("candidate_spans")))
    e = e.withColumn("__eval", span_keys(F.col("evaluated_spans"))).withColumn("__res", span_keys(F.col("results")))
    e = e.join(queries.select(F.col("id").alias("query_id"), F.lit(True).alias("__known")), "query_id", "left")
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    same = lambda x, y: inside(x, y) & inside(y, x)
    once = lambda x: F.col(x).isNull() | (F.size(F.array_distinct(F.col(x))) == F.size(F.col(x)))
    model, fast, deep = F.col("mode") != "lexical", F.col("mode") == "fast", F.col("mode") == "deep"
    finite = lambda r: r["score"].isNull() | (~F.isnan(r["score"]) & (F.abs(r["score"]) < float("inf")))
    rules = {
        "unknown_query": F.col("__known").isNotNull(), "unknown_mode": F.col("mode").isin(*MODES), "missing_contract": filled("chunk_contract_id"),
        "missing_all_spans": F.col("all_chunk_spans").isNotNull(), "missing_results": F.col("results").isNotNull(),
        "duplicate_ranks": F.size(F.array_distinct(F.col("results.rank"))) == F.size("results"), "bad_rank": ~F.exists("results", lambda r: r["rank"].isNull() | (r["rank"] < 1)),
        "bad_score": ~F.exists("results", lambda r: ~finite(r)),
        "duplicate_spans": once("__all") & once("__cand") & once("__eval"),
        "missing_evaluated": ~model | F.col("evaluated_spans").isNotNull(), "evaluated_in_all": ~model | inside(F.col("__eval"), F.col("__all")),
        "results_evaluated": ~model | inside(F.col("__res"), F.col("__eval")),
        "candidates_evaluated": ~fast | same(F.col("__cand"), F.col("__eval")),
        "over_candidate_limit": ~fast | F.col("candidate_limit").isNull() | (F.size("__cand") <= F.col("candidate_limit")),
        "deep_incomplete": ~deep | F.coalesce(F.col("scoring_complete"), F.lit(False)), "deep_not_all": ~deep | same(F.col("__eval"), F.col("__all")),
        "deep_candidates": ~deep | F.col("candidate_spans").isNull() | same(F.col("__cand"), F.col("__all")),
    }
    name = F.concat_ws(":", "query_id", "mode")
    empty = F.expr("CAST(array() AS array<struct<path:string,start_byte:bigint,end_byte:bigint>>)")
    spans = e.select(name.alias("subject"), F.explode(F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in ("__all", "__cand", "__eval", "__res")]))).alias("s")).select("subject", "s.*")
    files = sources.select("path", F.octet_length(F.coalesce("text", F.lit(""))).alias("__size"))
    outside = spans.join(files, "path", "left")
    where = _broken(outside, F.concat_ws(":", "subject", "path", F.col("start_byte").cast("string")), {
        "unknown_path": F.col("__size").isNotNull(),
        "outside_file": F.col("__size").isNull() | ((F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.col("__size"))),
    })
    sets = e.groupBy("query_id").agg(F.count_distinct("chunk_contract_id").alias("contracts"), F.size(F.collect_set(F.array_sort("__all"))).alias("sets"))
    agree = _broken(sets, F.col("query_id"), {"contracts_differ": F.col("contracts") <= 1, "chunk_sets_differ": F.col("sets") <= 1})
    return _all([_broken(e, name, rules), where, duplicates(events, ["query_id", "mode"], "duplicate_event"), agree])
