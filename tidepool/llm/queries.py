"""The ten operators' queries over the driver's tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe, decontaminate, langid, licenses, linededup, minhash, quality, sharding, tokencount, urlfilter

#: Verdict and host/path; fixed values of the query.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SHARDS = 8


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.labelled(licenses.scan(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_matches(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
    return langid.predict(docs, langid.fit(docs.where(~held_out)), held_out=held_out)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_bpe, op3_decontaminate, op4_sharding, op5_url_filter, op6_line_dedup,
            op7_token_counts, op8_language_id, op9_quality_rules, op10_near_dedup,
        )
    }


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM bl)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP5 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u),
r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)}),
rr AS (SELECT verdict, rule, split_part(rule, '/', 1) rhost, substr(rule, strpos(rule, '/')) rpath FROM r),
m AS (SELECT page_id, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
      FROM p JOIN rr ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') verdict FROM p LEFT JOIN m USING (page_id)
"""

_OP6 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line_no, regexp_extract_all({_LOWER.format("line")}, '{_SPACED}') w FROM l),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(w)) s FROM w WHERE len(w) > 0),
c AS (SELECT s, min({{'d': doc_id, 'l': line_no}}) f FROM t GROUP BY s),
g AS (SELECT f, len(s) n, unnest(s) g FROM c),
k AS (SELECT x.f a, y.f b, count(*) i, any_value(x.n) na, any_value(y.n) nb FROM g x JOIN g y ON x.g = y.g AND x.f <> y.f GROUP BY x.f, y.f),
m AS (SELECT a, count(*) n_links, min(b) b FROM k WHERE 10 * i >= 8 * (na + nb - i) GROUP BY a)
SELECT doc_id, CAST(line_no AS INTEGER) line_no, CAST(len(t.s) AS BIGINT) n_tokens, f.d class_id, CAST(f.l AS INTEGER) class_line, coalesce(n_links, 0) n_links,
       b.d match_id, CAST(b.l AS INTEGER) match_line, f <> {{'d': doc_id, 'l': line_no}} OR coalesce(b < f, false) removed
FROM t JOIN c ON t.s = c.s LEFT JOIN m ON m.a = c.f
"""


def _quality_sql() -> str:
    held = []
    for rule in quality.RULES:
        bounds = [f"{rule.measure} >= {rule.least}"] * (rule.least is not None) + [f"{rule.measure} <= {rule.most}"] * (rule.most is not None)
        held.append(f"(n_words < {rule.from_words} OR ({' AND '.join(bounds)}))")
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM w)),
r AS (SELECT doc_id, count(DISTINCT k) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, len(l) n_lines,
             coalesce(r.n, 0) n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) n_stop FROM w LEFT JOIN r USING (doc_id)),
x AS (SELECT *, word_chars / greatest(n_words, 1) mean_word_chars, n_symbols / greatest(word_chars, 1) symbol_ratio,
             n_stop / greatest(n_words, 1) stop_ratio, n_dup_lines / greatest(n_lines, 1) dup_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(held)} kept FROM x
"""


_OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) s FROM w),
g AS (SELECT doc_id, len(s) n, unnest(s) g FROM s),
k AS (SELECT x.doc_id a, y.doc_id b, count(*) i, any_value(x.n) na, any_value(y.n) nb FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k WHERE 100 * i >= 85 * (na + nb - i)),
r AS (SELECT doc_id a, doc_id b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a doc_id, min(b) component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) n_shingles, component_id, doc_id = component_id kept FROM s JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op5_url_filter": _OP5, "op6_line_dedup": _OP6, "op9_quality_rules": _quality_sql(), "op10_near_dedup": _OP10}
