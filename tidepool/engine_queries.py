"""Queries of the search and evaluation engine over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import text as tx
from tidepool.operators import candidates, chunking, contracts, evaluate, fitting, lexical, report, scoring
from tidepool.operators.search import search, suppress_overlaps
from tidepool.plans.ranking import global_rank
from tidepool.sources import corpora, tables

QUERY = "src3 en released under the MIT license version 3"
TOP_K = 10
LINES = 3
_REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _REGISTERED[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_sources(_table(spark, sf_dir, "documents"))


# Pieces of SQL -------------------------------------------------------------------------------------------------------
_S = """src AS (SELECT doc_id source_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' path,
  coalesce(text, '') text, CAST(strlen(coalesce(text, '')) AS BIGINT) len_bytes FROM documents)"""


def _terms_sql(x: str) -> str:
    parts = "v"
    for a, b in ((r"(\p{Ll})(\p{Lu})", r"\1_\2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1_\2"), (r"([0-9])([^0-9_])", r"\1_\2"), (r"([^0-9_])([0-9])", r"\1_\2")):
        parts = f"regexp_replace({parts}, '{a}', '{b}', 'g')"
    return rf"""flatten(list_transform(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda v: regexp_matches(v, '[^_]')),
      lambda v: list_concat([lower(v)], list_filter(list_transform(string_split_regex({parts}, '_+'), lambda p: lower(p)), lambda p: p <> '' AND p <> lower(v)))))"""


_L = f"""{_S}, parts AS (SELECT source_id, path, len_bytes, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) k, len(string_split(text, chr(10))) n FROM src),
lines AS (SELECT source_id, path, len_bytes, line, k, n, coalesce(CAST(sum(strlen(line) + 1) OVER (PARTITION BY source_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) start_byte FROM parts),
li AS (SELECT *, least(start_byte + strlen(line) + 1, len_bytes) end_byte FROM lines)"""
_B = f"""{_L}, bl AS (SELECT source_id, path, (k - 1) // {LINES} blk, min(start_byte) start_byte, max(end_byte) end_byte, min(k) start_line, max(k) end_line,
  string_agg(line, chr(10) ORDER BY k) || CASE WHEN max(k) < any_value(n) THEN chr(10) ELSE '' END passage FROM li GROUP BY source_id, path, blk),
blocks AS (SELECT *, row_number() OVER (ORDER BY source_id, start_byte) - 1 chunk_index FROM bl WHERE passage <> '')"""


def _bm25_sql(chunks: str) -> str:
    asked = tx.query_terms(QUERY)
    n = range(len(asked))
    tf = ", ".join(f"len(list_filter({s}, lambda v: v = '{t}')) {s}{k}" for s in "bp" for k, t in enumerate(asked))
    df = ", ".join(f"sum(CASE WHEN {s}{k} > 0 THEN 1 ELSE 0 END) d{s}{k}" for s in "bp" for k in n)
    one = lambda s: " + ".join(
        f"CASE WHEN {s}{k} > 0 THEN ln((n - d{s}{k} + 0.5e0) / (d{s}{k} + 0.5e0) + 1) * {s}{k} * 2.2e0 / ({s}{k} + 1.2e0 * (0.25e0 + 0.75e0 * {s}_len / ({s}_total / n))) ELSE 0 END" for k in n
    )
    return f"""t AS (SELECT * EXCLUDE (passage), {_terms_sql("passage")} b, {_terms_sql("path")} p FROM {chunks}),
c AS (SELECT * EXCLUDE (b, p), {tf}, len(b) b_len, len(p) p_len FROM t),
st AS (SELECT CAST(count(*) AS DOUBLE) n, CAST(sum(b_len) AS DOUBLE) b_total, CAST(sum(p_len) AS DOUBLE) p_total, {df} FROM c),
s0 AS (SELECT c.*, round({one("b")}, 6) body_score, round({one("p")}, 6) path_score FROM c, st),
scored AS (SELECT *, round(body_score + path_score, 6) score FROM s0)"""


_DOCS = "docs AS (SELECT source_id chunk_index, source_id, path, CAST(0 AS BIGINT) start_byte, len_bytes end_byte, text passage FROM src WHERE text <> '')"


# Sources -------------------------------------------------------------------------------------------------------------
@_query(f"WITH {_S} SELECT source_id, path, len_bytes, CAST(length(text) AS BIGINT) n_points FROM src")
def source_scan(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_id", "path", "len_bytes", F.char_length("text").cast("long").alias("n_points"))


@_query(f"WITH {_S} SELECT CASE WHEN contains(text, chr(0)) THEN 'nul_byte' ELSE 'ok' END policy, count(*) n, CAST(sum(len_bytes) AS BIGINT) total FROM src GROUP BY 1")
def content_policy(spark, sf_dir):
    return tables.content_policy(_sources(spark, sf_dir)).groupBy("policy").agg(F.count("*").alias("n"), F.sum("len_bytes").alias("total"))


@_query(f"WITH {_S} SELECT source_id, len_bytes FROM src WHERE len_bytes <= 2048")
def file_size_filter(spark, sf_dir):
    return tables.size_filter(_sources(spark, sf_dir), 2048).select("source_id", "len_bytes")


@_query(f"""WITH {_S}, e AS (SELECT *, CAST(sum(len_bytes) OVER (ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING) AS BIGINT) cum_bytes FROM src WHERE len_bytes <= 65536)
SELECT source_id, path, cum_bytes FROM e WHERE cum_bytes - len_bytes < 1000000 AND cum_bytes <= 1000000""")
def byte_budget(spark, sf_dir):
    return tables.byte_budget(_sources(spark, sf_dir), 1_000_000, 65536).select("source_id", "path", "cum_bytes")


@_query(f"WITH {_L} SELECT source_id, CAST(k AS INTEGER) line, start_byte, end_byte FROM li")
def line_index(spark, sf_dir):
    return tables.line_index(_sources(spark, sf_dir))


@_query(f"WITH {_L} SELECT source_id, CAST(count(*) AS INTEGER) line FROM li WHERE start_byte <= len_bytes // 2 GROUP BY source_id")
def byte_to_line(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return s.select("source_id", tables.byte_to_line(tables.line_starts(F.col("text")), F.floor(F.col("len_bytes") / 2), F.col("len_bytes")).alias("line"))


@_query(f"WITH {_L} SELECT source_id, CAST(k AS INTEGER) line, line || CASE WHEN k < n THEN chr(10) ELSE '' END slice FROM li")
def span_slice(spark, sf_dir):
    s = _sources(spark, sf_dir)
    rows = tables.line_index(s).join(s.select("source_id", "text"), "source_id")
    return rows.select("source_id", "line", tables.span_slice(F.col("text"), F.col("start_byte"), F.col("end_byte")).alias("slice"))


@_query(f"WITH {_S} SELECT source_id, path FROM src WHERE regexp_matches(path, '^.*/de/.*$') OR regexp_matches(path, '^src1.*7\\.txt$')")
def glob_filter(spark, sf_dir):
    return tables.glob_filter(_sources(spark, sf_dir), ["*/de/*", "src1*7.txt"]).select("source_id", "path")


@_query(f"WITH {_S} SELECT source_id, path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 place FROM src")
def path_order(spark, sf_dir):
    return global_rank(_sources(spark, sf_dir).select("source_id", "path"), [tx.path_order(F.col("path"))], "place")


@_query("SELECT doc_id, sha256(text) digest FROM documents WHERE text IS NOT NULL")
def sha256_verify(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.sha256(F.col("text")).alias("digest"))


# Terms ---------------------------------------------------------------------------------------------------------------
@_query(rf"WITH {_S} SELECT source_id, CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS BIGINT) n FROM src")
def token_estimate(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_id", tx.token_estimate(F.col("text")).alias("n"))


@_query(f"WITH {_S} SELECT source_id, array_to_string({_terms_sql('text')}, ' ') terms, array_to_string({_terms_sql('path')}, ' ') path_terms FROM src")
def normalized_terms(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return s.select("source_id", F.array_join(tx.terms(F.col("text")), " ").alias("terms"), F.array_join(tx.terms(F.col("path")), " ").alias("path_terms"))


@_query(f"WITH {_S} SELECT source_id, CAST(len(list_distinct({_terms_sql('text')})) AS BIGINT) n FROM src")
def distinct_terms(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_id", F.size(F.array_distinct(tx.terms(F.col("text")))).cast("long").alias("n"))


@_query(f"WITH {_S}, t AS (SELECT source_id, unnest({_terms_sql('text')}) term FROM src) SELECT source_id, term, count(*) tf FROM t GROUP BY ALL")
def term_freq(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("source_id", "term").agg(F.count("*").alias("tf"))


@_query(f"WITH {_S}, t AS (SELECT unnest(list_distinct({_terms_sql('text')})) term FROM src) SELECT term, count(*) df FROM t GROUP BY term")
def doc_freq(spark, sf_dir):
    return _sources(spark, sf_dir).select(F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@_query(f"WITH {_S}, t AS (SELECT len({_terms_sql('text')}) n FROM src) SELECT count(*) chunks, CAST(sum(n) AS BIGINT) total, round(avg(n), 6) average FROM t")
def doc_length_stats(spark, sf_dir):
    n = _sources(spark, sf_dir).select(F.size(tx.terms(F.col("text"))).alias("n"))
    return n.agg(F.count("*").alias("chunks"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("average"))


# Lexical search ------------------------------------------------------------------------------------------------------
def _scored(spark, sf_dir) -> DataFrame:
    return lexical.score(chunking.whole_documents(_sources(spark, sf_dir)), QUERY, digits=6)


@_query(f"WITH {_S}, {_DOCS}, {_bm25_sql('docs')} SELECT chunk_index, body_score FROM scored WHERE body_score > 0")
def bm25_body(spark, sf_dir):
    return _scored(spark, sf_dir).where("body_score > 0").select("chunk_index", "body_score")


@_query(f"WITH {_S}, {_DOCS}, {_bm25_sql('docs')} SELECT chunk_index, path_score FROM scored WHERE path_score > 0")
def bm25_path(spark, sf_dir):
    return _scored(spark, sf_dir).where("path_score > 0").select("chunk_index", "path_score")


@_query(f"WITH {_S}, {_DOCS}, {_bm25_sql('docs')} SELECT chunk_index, path, score FROM scored WHERE score > 0")
def bm25_combined(spark, sf_dir):
    return _scored(spark, sf_dir).select("chunk_index", "path", "score")


@_query(f"""WITH {_S}, {_DOCS}, {_bm25_sql('docs')} SELECT CAST(row_number() OVER (ORDER BY score DESC, string_split(path, '/'), start_byte, end_byte, source_id, chunk_index) AS INTEGER) AS rank,
chunk_index, path, body_score, path_score, score FROM scored WHERE score > 0 ORDER BY rank LIMIT {TOP_K}""")
def lexical_topk(spark, sf_dir):
    report = search(chunking.whole_documents(_sources(spark, sf_dir)), QUERY, top_k=TOP_K, digits=6)
    return report.results.select("rank", "chunk_index", "path", "body_score", "path_score", "score")


# Chunks --------------------------------------------------------------------------------------------------------------
def _blocks(spark, sf_dir) -> DataFrame:
    """Chunks of three lines of each document, by a projection, numbered."""
    s = _sources(spark, sf_dir).select("*", F.split("text", "\n", -1).alias("lines"), tables.line_starts(F.col("text")).alias("starts"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES).cast("int")))).withColumn("first", F.col("k") * LINES)
    last = F.col("first") + LINES >= F.size("lines")
    rows = s.select(
        "source_id", "path", F.get("starts", F.col("first")).alias("start_byte"), F.when(last, F.col("len_bytes")).otherwise(F.get("starts", F.col("first") + LINES)).alias("end_byte"),
        (F.col("first") + 1).alias("start_line"), F.least(F.col("first") + LINES, F.size("lines")).alias("end_line"), F.lit("lines").alias("kind"),
        F.concat(F.array_join(F.slice("lines", F.col("first") + 1, F.lit(LINES)), "\n"), F.when(last, "").otherwise("\n")).alias("passage"),
    ).where("passage <> ''")
    return chunking.number(rows)


@_query(f"WITH {_B} SELECT chunk_index, source_id, start_byte, CAST(end_byte AS BIGINT) end_byte, CAST(start_line AS INTEGER) start_line, CAST(end_line AS INTEGER) end_line, sha256(passage) digest FROM blocks")
def chunk_fixed_lines(spark, sf_dir):
    return _blocks(spark, sf_dir).select("chunk_index", "source_id", "start_byte", "end_byte", "start_line", "end_line", F.sha2("passage", 256).alias("digest"))


@_query()
def chunk_default(spark, sf_dir):
    return chunking.number(chunking.chunk(_sources(spark, sf_dir)))


@_query()
def chunk_cap(spark, sf_dir):
    """The shared cap on chunks is the feature here."""
    return chunking.number(chunking.chunk(_sources(spark, sf_dir)), 500).select("chunk_index", "source_id", "start_byte", "end_byte", "kind")


@_query()
def fit_chunks(spark, sf_dir):
    chunks = chunking.chunk(_sources(spark, sf_dir))
    return fitting.fit(chunks, QUERY, 400, lambda q, p: len(q) + len(p) + 3)


@_query(f"WITH {_B} SELECT chunk_index, CASE WHEN length(passage) > 500 THEN substr(passage, 1, 500) || '…' ELSE passage END snippet FROM blocks")
def snippet(spark, sf_dir):
    return _blocks(spark, sf_dir).select("chunk_index", tx.snippet(F.col("passage")).alias("snippet"))


# Candidates ----------------------------------------------------------------------------------------------------------
@_query(f"""WITH {_B}, {_bm25_sql('blocks')}, w AS (SELECT chunk_index, lag(chunk_index) OVER x p, lead(chunk_index) OVER x q FROM blocks WINDOW x AS (PARTITION BY source_id ORDER BY start_byte, end_byte)),
h AS (SELECT w.* FROM w JOIN scored USING (chunk_index) WHERE score > 0)
SELECT chunk_index hit_index, 0 side, p chunk_index FROM h WHERE p IS NOT NULL UNION ALL SELECT chunk_index, 1, q FROM h WHERE q IS NOT NULL""")
def neighbours(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return candidates.neighbours(blocks, lexical.score(blocks, QUERY, digits=6)).select("hit_index", "side", "chunk_index")


_DEPTH = """d AS (SELECT DISTINCT n FROM {0}), walk(n, a, b, depth) AS (SELECT n, {1}, {2}, 0 FROM d UNION ALL
  SELECT n, u.a, u.b, depth + 1 FROM (SELECT n, depth, unnest([{{'a': a, 'b': a + (b - a) // 2}}, {{'a': a + (b - a) // 2 + 1, 'b': b}}]) u FROM walk WHERE a < b)),
mid AS (SELECT n, a + (b - a) // 2 pos, depth FROM walk WHERE a < b)"""


@_query(f"""WITH RECURSIVE {_B}, pl AS (SELECT chunk_index, source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_byte) - 1 pos, count(*) OVER (PARTITION BY source_id) n FROM blocks),
{_DEPTH.format("pl", "CAST(0 AS BIGINT)", "n")} SELECT chunk_index, row_number() OVER (PARTITION BY source_id ORDER BY depth, pos) - 1 midpoint_rank FROM pl JOIN mid USING (n, pos)""")
def midpoint_order(spark, sf_dir):
    return candidates.midpoints(_blocks(spark, sf_dir)).select("chunk_index", "midpoint_rank")


_SPREAD = f"""pl AS (SELECT source_id, row_number() OVER (ORDER BY string_split(path, '/')) - 1 pos, count(*) OVER () n FROM (SELECT DISTINCT source_id, path FROM blocks)),
{_DEPTH.format("pl", "CAST(1 AS BIGINT)", "n - 1")}, sp AS (SELECT source_id, row_number() OVER (ORDER BY CASE WHEN pos = 0 THEN -2 WHEN pos = pl.n - 1 THEN -1 ELSE depth END, pos) - 1 spread_rank
  FROM pl LEFT JOIN mid USING (n, pos))"""


@_query(f"WITH RECURSIVE {_B}, {_SPREAD} SELECT source_id, spread_rank FROM sp")
def spread_order(spark, sf_dir):
    return candidates.spread(_blocks(spark, sf_dir))


def _renamed(sql: str, names: dict[str, str]) -> str:
    """Pieces of SQL under other table names, so that two of them can stand in one statement."""
    for old, new in names.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return sql


_MIDPOINT = f"""mpl AS (SELECT chunk_index, source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_byte) - 1 pos, count(*) OVER (PARTITION BY source_id) n FROM blocks),
{_renamed(_DEPTH.format("mpl", "CAST(0 AS BIGINT)", "n"), {"d": "md", "walk": "mwalk", "mid": "mmid"})},
mp AS (SELECT chunk_index, source_id, row_number() OVER (PARTITION BY source_id ORDER BY depth, pos) - 1 midpoint_rank FROM mpl JOIN mmid USING (n, pos))"""
_DIVERSE = f"{_MIDPOINT}, {_SPREAD}, dv AS (SELECT chunk_index, midpoint_rank, spread_rank FROM mp JOIN sp USING (source_id))"
_FIELDS = "score DESC, body_score DESC, path_score DESC"
_PLACE = "string_split(path, '/'), start_byte, end_byte, source_id, chunk_index"
# each stage takes its quota of 128 from what no earlier one took; hits and the diverse order fill up
_CHOSEN = f"""{_DIVERSE}, nb AS (SELECT chunk_index hit_index, lag(chunk_index) OVER x p, lead(chunk_index) OVER x q FROM blocks WINDOW x AS (PARTITION BY source_id ORDER BY start_byte, end_byte)),
nr AS (SELECT hit_index, unnest([{{'s': 0, 'c': p}}, {{'s': 1, 'c': q}}]) u FROM nb),
ns AS (SELECT u.c chunk_index, hit_index, u.s side, score, body_score, path_score, row_number() OVER (PARTITION BY u.c ORDER BY {_FIELDS}, hit_index, u.s) r
  FROM nr JOIN scored ON scored.chunk_index = hit_index WHERE u.c IS NOT NULL AND score > 0),
s1 AS (SELECT chunk_index, 1 stage, row_number() OVER (ORDER BY body_score DESC, {_PLACE}) o FROM scored WHERE body_score > 0 QUALIFY o <= 80),
s2 AS (SELECT chunk_index, 2 stage, row_number() OVER (ORDER BY path_score DESC, {_PLACE}) o FROM scored WHERE path_score > 0 AND chunk_index NOT IN (SELECT chunk_index FROM s1) QUALIFY o <= 16),
t2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
s3 AS (SELECT chunk_index, 3 stage, row_number() OVER (ORDER BY {_FIELDS}, hit_index, side) o FROM ns WHERE r = 1 AND chunk_index NOT IN (SELECT chunk_index FROM t2) QUALIFY o <= 16),
t3 AS (SELECT * FROM t2 UNION ALL SELECT * FROM s3),
s4 AS (SELECT chunk_index, 4 stage, row_number() OVER (ORDER BY midpoint_rank, spread_rank, chunk_index) o FROM dv WHERE chunk_index NOT IN (SELECT chunk_index FROM t3) QUALIFY o <= 16),
t4 AS (SELECT * FROM t3 UNION ALL SELECT * FROM s4),
s5 AS (SELECT chunk_index, 5 stage, row_number() OVER (ORDER BY {_FIELDS}, chunk_index) o FROM scored WHERE score > 0 AND chunk_index NOT IN (SELECT chunk_index FROM t4) QUALIFY o <= 128 - (SELECT count(*) FROM t4)),
t5 AS (SELECT * FROM t4 UNION ALL SELECT * FROM s5),
s6 AS (SELECT chunk_index, 6 stage, row_number() OVER (ORDER BY midpoint_rank, spread_rank, chunk_index) o FROM dv WHERE chunk_index NOT IN (SELECT chunk_index FROM t5) QUALIFY o <= 128 - (SELECT count(*) FROM t5)),
t6 AS (SELECT * FROM t5 UNION ALL SELECT * FROM s6),
chosen AS (SELECT chunk_index, row_number() OVER (ORDER BY stage, o) - 1 place FROM t6)"""


@_query(f"WITH RECURSIVE {_B}, {_DIVERSE} SELECT chunk_index, midpoint_rank, spread_rank FROM dv")
def diverse_order(spark, sf_dir):
    return candidates.diverse(_blocks(spark, sf_dir)).select("chunk_index", "midpoint_rank", "spread_rank")


@_query("SELECT * FROM (VALUES (1, 1, 0, 0, 0), (3, 2, 1, 0, 0), (4, 3, 1, 0, 0), (8, 5, 1, 1, 1), (10, 7, 1, 1, 1), (128, 80, 16, 16, 16)) t(k, body, path, neighbours, diverse)")
def candidate_quota(spark, sf_dir):
    rows = [(k, *candidates.quota(k).values()) for k in (1, 3, 4, 8, 10, 128)]
    return spark.createDataFrame(rows, "k int, body int, path int, neighbours int, diverse int")


@_query(f"WITH RECURSIVE {_B}, {_bm25_sql('blocks')}, {_CHOSEN} SELECT chunk_index, CAST(place AS INTEGER) place FROM chosen")
def candidate_selection(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    every = lexical.score(blocks, QUERY, digits=6, keep_all=True)
    chosen = candidates.select(every, every.where("score > 0"), 128)
    return spark.createDataFrame([(i, k) for k, i in enumerate(chosen.indexes)], "chunk_index long, place int")


# Spans of three lines that start at every line, ranked by their length: two neighbours overlap by two thirds.
_SL = f"""{_L}, sl AS (SELECT x.source_id, x.path, x.k, x.start_byte, y.end_byte FROM li x JOIN li y ON x.source_id = y.source_id AND y.k = least(x.k + 2, x.n) WHERE x.len_bytes > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY end_byte - start_byte DESC, start_byte) r FROM sl)"""


@_query(f"""WITH RECURSIVE {_SL}, g(source_id, r, kept, taken) AS (
  SELECT source_id, r, [{{'a': start_byte, 'b': end_byte}}], true FROM rk WHERE r = 1
  UNION ALL
  SELECT source_id, r, CASE WHEN hit THEN kept ELSE list_append(kept, {{'a': a, 'b': b}}) END, NOT hit FROM (
    SELECT g.source_id, rk.r, kept, rk.start_byte a, rk.end_byte b,
      len(list_filter(kept, lambda y: least(y.b - y.a, rk.end_byte - rk.start_byte) > 0 AND greatest(least(y.b, rk.end_byte) - greatest(y.a, rk.start_byte), 0) / CAST(least(y.b - y.a, rk.end_byte - rk.start_byte) AS DOUBLE) >= 0.6e0)) > 0 hit
    FROM g JOIN rk ON rk.source_id = g.source_id AND rk.r = g.r + 1))
SELECT rk.source_id, start_byte, end_byte FROM g JOIN rk USING (source_id, r) WHERE taken""")
def overlap_suppression(spark, sf_dir):
    s = _sources(spark, sf_dir).where("len_bytes > 0").select("source_id", "path", "len_bytes", tables.line_starts(F.col("text")).alias("starts"))
    rows = s.select("*", F.posexplode("starts").alias("k", "start_byte"))
    end = F.when(F.col("k") + LINES < F.size("starts"), F.get("starts", F.col("k") + LINES)).otherwise(F.col("len_bytes"))
    rows = rows.select("source_id", "path", "start_byte", end.alias("end_byte"))
    return suppress_overlaps(rows, [F.desc(F.col("end_byte") - F.col("start_byte")), F.asc("start_byte")]).select("source_id", "start_byte", "end_byte")


_ASKED = ", ".join(f"'{t}'" for t in tx.query_terms(QUERY))


@_query(f"""WITH {_B}, m AS (SELECT chunk_index, path, source_id, start_byte, end_byte,
  CAST(len(list_filter([{_ASKED}], lambda q: list_contains({_terms_sql('passage')}, q))) - length(passage) / 1000e0 AS FLOAT) logit FROM blocks)
SELECT CAST(row_number() OVER (ORDER BY logit DESC, string_split(path, '/'), start_byte, end_byte, source_id, chunk_index) AS INTEGER) AS rank, chunk_index, round(CAST(logit AS DOUBLE), 6) logit FROM m ORDER BY rank LIMIT {TOP_K}""")
def deep_search_sql_scorer(spark, sf_dir):
    report = search(_blocks(spark, sf_dir), QUERY, "deep", TOP_K, score_column=lambda p: scoring.coverage_score(QUERY, p), digits=6)
    return report.results.select("rank", "chunk_index", F.round(F.col("relevance_logit").cast("double"), 6).alias("logit"))


_LOGIT = f"CAST(len(list_filter([{_ASKED}], lambda q: list_contains({_terms_sql('passage')}, q))) - length(passage) / 1000e0 AS FLOAT)"


@_query(f"""WITH RECURSIVE {_B}, {_bm25_sql('blocks')}, {_CHOSEN}, m AS (SELECT chunk_index, path, source_id, start_byte, end_byte, {_LOGIT} logit FROM blocks WHERE chunk_index IN (SELECT chunk_index FROM chosen))
SELECT CAST(row_number() OVER (ORDER BY logit DESC, {_PLACE}) AS INTEGER) AS rank, chunk_index, round(CAST(logit AS DOUBLE), 6) logit FROM m ORDER BY rank LIMIT {TOP_K}""")
def fast_search_sql_scorer(spark, sf_dir):
    report = search(_blocks(spark, sf_dir), QUERY, "fast", TOP_K, 128, score_column=lambda p: scoring.coverage_score(QUERY, p), digits=6)
    return report.results.select("rank", "chunk_index", F.round(F.col("relevance_logit").cast("double"), 6).alias("logit"))


# Evaluation: a benchmark passage is a query; documents' lines that start with its first two words are evidence; the lines of
# documents with evidence are results, in text order (deep) and by length (fast).
_E = rf"""{_L}, q AS (SELECT CAST(item_id AS VARCHAR) query_id, CAST(item_id % 7 AS VARCHAR) category, CASE WHEN item_id % 2 = 0 THEN 'development' ELSE 'holdout' END split,
  array_to_string(string_split(text, ' ')[1:2], ' ') start FROM benchmark WHERE text IS NOT NULL),
lab AS (SELECT query_id, path || ':' || CAST(k AS VARCHAR) evidence_id, path, source_id, start_byte, end_byte, 1 + CAST(k % 2 AS INTEGER) relevance FROM li JOIN q ON array_to_string(string_split(line, ' ')[1:2], ' ') = q.start WHERE line <> ''),
hit AS (SELECT DISTINCT query_id, source_id FROM lab),
res AS (SELECT query_id, path, start_byte, end_byte, unnest([{{'m': 'deep', 'o': 0}}, {{'m': 'fast', 'o': 1}}]) u FROM hit JOIN li USING (source_id)),
rs AS (SELECT query_id, u.m AS mode, path, start_byte, end_byte, row_number() OVER (PARTITION BY query_id, u.m ORDER BY u.o * (start_byte - end_byte), string_split(path, '/'), start_byte) AS rank FROM res),
ev AS (SELECT rs.*, evidence_id, relevance, greatest(least(rs.end_byte, lab.end_byte) - greatest(rs.start_byte, lab.start_byte), 0) / CAST(lab.end_byte - lab.start_byte AS DOUBLE) coverage
  FROM rs JOIN lab ON rs.query_id = lab.query_id AND rs.path = lab.path AND rs.start_byte < lab.end_byte AND rs.end_byte > lab.start_byte
  WHERE greatest(least(rs.end_byte, lab.end_byte) - greatest(rs.start_byte, lab.start_byte), 0) / CAST(lab.end_byte - lab.start_byte AS DOUBLE) >= 0.5e0)"""
_M = f"""{_E}, un AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode, evidence_id ORDER BY rank) f FROM ev),
br AS (SELECT query_id, mode, rank, max(relevance) relevance FROM un WHERE f = 1 GROUP BY ALL),
fo AS (SELECT query_id, mode, min(CASE WHEN rank <= 10 THEN rank END) first_rank, sum(CASE WHEN rank <= 10 THEN (pow(2, relevance) - 1) / log2(rank + 1) ELSE 0 END) dcg FROM br GROUP BY ALL),
ir AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, evidence_id) r FROM lab),
id AS (SELECT query_id, sum((pow(2, relevance) - 1) / log2(r + 1)) ideal FROM ir WHERE r <= 10 GROUP BY query_id),
me AS (SELECT e.query_id, e.mode, q.split, q.category, coalesce(first_rank <= 5, false) hit_at_5, coalesce(1e0 / first_rank, 0) mrr_at_10, coalesce(dcg / ideal, 0) ndcg_at_10
  FROM (SELECT DISTINCT query_id, mode FROM rs) e JOIN q USING (query_id) LEFT JOIN fo ON e.query_id = fo.query_id AND e.mode = fo.mode LEFT JOIN id ON e.query_id = id.query_id)"""


def _evaluation(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, labels, results)."""
    b = _table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    queries = b.select(
        F.col("item_id").cast("string").alias("query_id"), (F.col("item_id") % 7).cast("string").alias("category"),
        F.when(F.col("item_id") % 2 == 0, "development").otherwise("holdout").alias("split"), F.substring_index("text", " ", 2).alias("start"),
    )
    s = _sources(spark, sf_dir).select("source_id", "path", "len_bytes", F.split("text", "\n", -1).alias("lines"), tables.line_starts(F.col("text")).alias("starts"))
    rows = s.select("source_id", "path", "len_bytes", F.posexplode(F.arrays_zip("lines", "starts")).alias("k", "x"))
    rows = rows.select("source_id", "path", (F.col("k") + 1).alias("k"), F.col("x.lines").alias("line"), F.col("x.starts").alias("start_byte"),
                       F.least(F.col("x.starts") + F.octet_length("x.lines") + 1, F.col("len_bytes")).alias("end_byte"))
    labels = rows.where("line <> ''").withColumn("start", F.substring_index("line", " ", 2)).join(queries.select("query_id", "start"), "start").select(
        "query_id", F.concat_ws(":", "path", F.col("k").cast("string")).alias("evidence_id"), "path", "source_id", "start_byte", "end_byte", (1 + F.col("k") % 2).alias("relevance")
    )
    hit = labels.select("query_id", "source_id").distinct()
    results = hit.join(rows, "source_id").select("query_id", "path", "start_byte", "end_byte", F.posexplode(F.array(F.lit("deep"), F.lit("fast"))).alias("o", "mode"))
    order = Window.partitionBy("query_id", "mode").orderBy(F.col("o") * (F.col("start_byte") - F.col("end_byte")), F.split("path", "/"), "start_byte")
    return queries.drop("start"), labels, results.withColumn("rank", F.row_number().over(order)).drop("o")


@_query(f"WITH {_E} SELECT query_id, mode, CAST(rank AS INTEGER) AS rank, path, evidence_id, round(coverage, 6) coverage FROM ev")
def evidence_join(spark, sf_dir):
    _, labels, results = _evaluation(spark, sf_dir)
    return evaluate.evidence_hits(results, labels).select("query_id", "mode", "rank", "path", "evidence_id", F.round("coverage", 6).alias("coverage"))


@_query(f"WITH {_M} SELECT query_id, mode, hit_at_5, round(mrr_at_10, 6) mrr_at_10, round(ndcg_at_10, 6) ndcg_at_10 FROM me")
def eval_metrics(spark, sf_dir):
    m = evaluate.metrics(*_evaluation(spark, sf_dir))
    return m.select("query_id", "mode", "hit_at_5", F.round("mrr_at_10", 6).alias("mrr_at_10"), F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


@_query(f"""WITH {_M} SELECT split, category, mode, count(*) queries, round(avg(CAST(hit_at_5 AS INTEGER)), 6) hit_at_5, round(avg(mrr_at_10), 6) mrr_at_10, round(avg(ndcg_at_10), 6) ndcg_at_10
FROM me GROUP BY GROUPING SETS ((mode), (split, mode), (category, mode))""")
def eval_summary_by_dim(spark, sf_dir):
    m = evaluate.summary(evaluate.metrics(*_evaluation(spark, sf_dir)), ["split", "category"])
    return m.select("split", "category", "mode", "queries", *[F.round(c, 6).alias(c) for c in ("hit_at_5", "mrr_at_10", "ndcg_at_10")])


@_query(f"""WITH {_E}, ca AS (SELECT l.query_id, e.mode, count(DISTINCT l.evidence_id) labels, count(DISTINCT v.evidence_id) coverable, count(DISTINCT CASE WHEN v.rank <= 5 THEN v.evidence_id END) hits
FROM lab l JOIN (SELECT DISTINCT query_id, mode FROM rs) e ON l.query_id = e.query_id LEFT JOIN ev v ON v.query_id = e.query_id AND v.mode = e.mode AND v.evidence_id = l.evidence_id GROUP BY ALL)
SELECT query_id, mode, labels, coverable, hits, round(hits / labels, 6) recall, round(hits / nullif(coverable, 0), 6) recall_given_coverable, hits > 0 candidate_hit FROM ca""")
def candidate_recall(spark, sf_dir):
    _, labels, results = _evaluation(spark, sf_dir)
    found = evaluate.candidate_recall(labels, results, results.where("rank <= 5"))
    return found.select("query_id", "mode", "labels", "coverable", "hits", F.round("candidate_evidence_recall", 6).alias("recall"), F.round("candidate_recall_given_coverable", 6).alias("recall_given_coverable"), "candidate_hit")


@_query(f"""WITH {_M}, tp AS (SELECT query_id, mode, list({{'p': path, 's': start_byte, 'e': end_byte}}) s FROM rs WHERE rank <= 10 GROUP BY ALL)
SELECT f.query_id, CAST(len(list_intersect(f.s, d.s)) AS INTEGER) intersection, round(len(list_intersect(f.s, d.s)) / len(list_distinct(list_concat(f.s, d.s))), 6) jaccard,
CAST(x.hit_at_5 AS INTEGER) - CAST(y.hit_at_5 AS INTEGER) hit_delta FROM tp f JOIN tp d ON f.query_id = d.query_id AND f.mode = 'fast' AND d.mode = 'deep'
JOIN me x ON x.query_id = f.query_id AND x.mode = 'fast' JOIN me y ON y.query_id = f.query_id AND y.mode = 'deep'""")
def fast_deep_overlap(spark, sf_dir):
    queries, labels, results = _evaluation(spark, sf_dir)
    out = evaluate.mode_overlap(results, evaluate.metrics(queries, labels, results))
    return out.select("query_id", "intersection", F.round("jaccard", 6).alias("jaccard"), "hit_delta")


@_query(f"""WITH {_S}, {_DOCS}, {_bm25_sql('docs')}, z AS (SELECT split_part(path, '/', 2) lang, score FROM scored WHERE score > 0)
SELECT lang, count(score) n, min(score) lo, round(quantile_cont(score, 0.5), 5) median, round(quantile_cont(score, 0.95), 5) p95, max(score) hi FROM z GROUP BY lang""")
def irrelevant_score_quantiles(spark, sf_dir):
    found = evaluate.quantiles(_scored(spark, sf_dir).withColumn("lang", F.split_part("path", F.lit("/"), F.lit(2))), "score", ["lang"])
    return found.select("lang", "n", "lo", F.round("median", 5).alias("median"), F.round("p95", 5).alias("p95"), "hi")


@_query(f"WITH {_S} SELECT split_part(path, '/', 1) grp, count(*) n, quantile_disc(len_bytes, 0.95) p95_nearest FROM src GROUP BY 1")
def nearest_rank_p95(spark, sf_dir):
    found = evaluate.quantiles(_sources(spark, sf_dir).withColumn("grp", F.split_part("path", F.lit("/"), F.lit(1))), "len_bytes", ["grp"])
    return found.select("grp", "n", F.col("p95_nearest").cast("long").alias("p95_nearest"))


@_query(f"""WITH {_E} SELECT q.query_id, m.mode FROM q, (VALUES ('deep'), ('fast'), ('lexical')) m(mode) WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.query_id = q.query_id AND rs.mode = m.mode)""")
def missing_events(spark, sf_dir):
    queries, _, results = _evaluation(spark, sf_dir)
    return evaluate.missing_events(queries, ["deep", "fast", "lexical"], results)


@_query(f"""WITH {_E}, a AS (SELECT query_id, md5(string_agg(path || ':' || CAST(start_byte AS VARCHAR), ',' ORDER BY path, start_byte)) h FROM rs WHERE mode = 'deep' GROUP BY query_id),
b AS (SELECT query_id, md5(string_agg(path || ':' || CAST(start_byte AS VARCHAR), ',' ORDER BY path, start_byte)) h FROM rs WHERE mode = 'fast' GROUP BY query_id)
SELECT query_id, a.h = b.h same FROM a JOIN b USING (query_id)""")
def chunk_set_equality(spark, sf_dir):
    _, _, results = _evaluation(spark, sf_dir)
    sets = results.groupBy("query_id").pivot("mode", ["deep", "fast"]).agg(F.array_sort(F.collect_set(F.struct("path", "start_byte"))))
    return sets.select("query_id", (F.col("deep") == F.col("fast")).alias("same"))


@_query(f"""WITH {_S}, l AS (SELECT path, sha256(text) h FROM src WHERE source_id % 10 <> 3), f AS (SELECT path, sha256(CASE WHEN source_id % 10 = 5 THEN text || ' ' ELSE text END) h FROM src WHERE source_id % 10 <> 7)
SELECT path, CASE WHEN f.h IS NULL THEN 'missing' WHEN l.h IS NULL THEN 'unlisted' ELSE 'changed' END problem FROM l FULL JOIN f USING (path) WHERE f.h IS NULL OR l.h IS NULL OR f.h <> l.h""")
def inventory_diff(spark, sf_dir):
    """Two inventories of the corpus that were made to differ: rows left out of each side, and changed ones."""
    s = _sources(spark, sf_dir)
    changed = F.when(F.col("source_id") % 10 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    listed = s.where("source_id % 10 <> 3").select("path", tx.sha256(F.col("text")).alias("sha256"))
    return evaluate.inventory_difference(listed, s.where("source_id % 10 <> 7").select("path", tx.sha256(changed).alias("sha256")))


# Contracts and reports: definitions that were made to break rules ----------------------------------------------------
@_query(f"""WITH {_L}, c AS (SELECT source_id, start_byte + CASE WHEN source_id % 11 = 1 THEN 1 ELSE 0 END a, end_byte - CASE WHEN source_id % 11 = 2 THEN end_byte - start_byte ELSE 0 END b,
  k + CASE WHEN source_id % 11 = 3 THEN 1 ELSE 0 END k, CASE WHEN source_id % 11 = 4 THEN -1 - source_id ELSE source_id END sid, len_bytes, line FROM li WHERE k = 1 AND len_bytes > 0),
p AS (SELECT *, sid <> source_id unknown FROM c), x AS (SELECT sid, a, b, unnest([CASE WHEN unknown THEN 'unknown_source' END,
  CASE WHEN NOT unknown AND (a > b OR (a = 1 AND substr(line, 1, 1) > chr(127))) THEN 'invalid_range' END, CASE WHEN NOT unknown AND a = b THEN 'empty_range' END,
  CASE WHEN NOT unknown AND a < b AND k <> 1 THEN 'wrong_lines' END]) problem FROM p)
SELECT problem, CAST(sid AS VCHAR) || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR) subject FROM x WHERE problem IS NOT NULL""".replace("VCHAR", "VARCHAR"))
def chunk_integrity(spark, sf_dir):
    """First lines as chunks, some of them of no source, empty, off a character's edge or with another line."""
    s = _sources(spark, sf_dir)
    rest = F.col("source_id") % 11
    first = tables.line_index(s.where("len_bytes > 0")).where("line = 1")
    made = first.select(
        F.when(rest == 4, -1 - F.col("source_id")).otherwise(F.col("source_id")).alias("source_id"), (F.col("start_byte") + (rest == 1).cast("int")).alias("start_byte"),
        F.when(rest == 2, F.col("start_byte")).otherwise(F.col("end_byte")).alias("end_byte"),
        *[(F.col("line") + (rest == 3).cast("int")).cast("int").alias(c) for c in ("start_line", "end_line")],
    )
    return contracts.chunk_problems(s, made)


def _definitions(spark, sf_dir) -> DataFrame:
    """Two variants of each benchmark passage as queries, one of them with faults by its id."""
    b = _table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.explode(F.array(F.lit("en"), F.lit("ko"))).alias("language"))
    i, ko = F.col("item_id"), F.col("language") == "ko"
    label = F.struct(
        F.concat(F.lit("e"), i.cast("string")).alias("evidence_id"), F.lit("a.txt").alias("path"), F.lit(0).cast("long").alias("start_byte"), (1 + (ko & (i % 7 == 3)).cast("int")).cast("long").alias("end_byte"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(1).alias("relevance"),
    )
    none = F.array_except(F.array(label), F.array(label))
    return b.select(
        F.concat_ws("-", i.cast("string"), "language").alias("id"), i.cast("string").alias("intent_id"), F.when(ko & (i % 7 == 1), "holdout").otherwise("development").alias("split"),
        F.lit("c").alias("category"), "language", F.lit("relevant").alias("query_type"), F.when(ko & (i % 7 == 2), " ").otherwise("q").alias("query"), F.array(F.lit("t")).alias("tags"),
        F.when(ko & (i % 7 == 4), none).otherwise(F.array(label)).alias("labels"),
    )


@_query("""WITH b AS (SELECT item_id i FROM benchmark WHERE text IS NOT NULL)
SELECT unnest(CASE i % 7 WHEN 1 THEN ['intent_split'] WHEN 2 THEN ['missing_query'] WHEN 3 THEN ['intent_labels'] WHEN 4 THEN ['labels_of_type', 'intent_labels'] ELSE [] END) problem,
  unnest(CASE i % 7 WHEN 1 THEN [CAST(i AS VARCHAR)] WHEN 2 THEN [i || '-ko'] WHEN 3 THEN [CAST(i AS VARCHAR)] WHEN 4 THEN [i || '-ko', CAST(i AS VARCHAR)] ELSE [] END) subject FROM b""")
def definition_problems(spark, sf_dir):
    made = _definitions(spark, sf_dir)
    return contracts.query_problems(made).unionByName(contracts.intent_problems(made))


@_query(f"""WITH {_M} SELECT count(*) query_pair_count, round(avg(len(list_intersect(f.s, d.s)) / len(list_distinct(list_concat(f.s, d.s)))), 6) top10_jaccard_mean,
round(avg(len(list_intersect(f.s, d.s))), 6) top10_intersection_mean, round(avg(CAST(y.hit_at_5 AS INTEGER) - CAST(x.hit_at_5 AS INTEGER)), 6) deep_minus_fast_hit_at_5
FROM (SELECT query_id, list({{'p': path, 's': start_byte, 'e': end_byte}}) s FROM rs WHERE rank <= 10 AND mode = 'fast' GROUP BY ALL) f
JOIN (SELECT query_id, list({{'p': path, 's': start_byte, 'e': end_byte}}) s FROM rs WHERE rank <= 10 AND mode = 'deep' GROUP BY ALL) d USING (query_id)
JOIN me x ON x.query_id = f.query_id AND x.mode = 'fast' JOIN me y ON y.query_id = f.query_id AND y.mode = 'deep'""")
def mode_comparison(spark, sf_dir):
    queries, labels, results = _evaluation(spark, sf_dir)
    out = report.compare_modes(evaluate.metrics(queries, labels, results), results)
    return out.select("query_pair_count", *[F.round(c, 6).alias(c) for c in ("top10_jaccard_mean", "top10_intersection_mean", "deep_minus_fast_hit_at_5")])


@_query("""WITH f AS (SELECT range i FROM range(50)) SELECT i source_id, format('module-{:04d}.rs', i) path, CAST(204 + CASE WHEN i < 40 THEN 1 ELSE 0 END AS INTEGER) n_bytes FROM f""")
def generated_corpus(spark, sf_dir):
    made = corpora.benchmark_corpus(spark, 50, 10_240)
    return made.select("source_id", "path", F.octet_length("text").alias("n_bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
