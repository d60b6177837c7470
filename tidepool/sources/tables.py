"""Text tables as sources: content policy, size limits, line index and byte positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.ranking import running_sum


def document_sources(docs: DataFrame) -> DataFrame:
    """(source_id, path, text, len_bytes) of a table of documents."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("source_id"), path.alias("path"), text.alias("text"), F.octet_length(text).cast("long").alias("len_bytes"))


def content_policy(sources: DataFrame) -> DataFrame:
    """Adds ``policy``: nul_byte, invalid_utf8 or ok, tested in that order."""
    return sources.withColumn(
        "policy",
        F.when(F.contains(F.col("text"), F.lit("\0")), "nul_byte").when(~F.is_valid_utf8("text"), "invalid_utf8").otherwise("ok"),
    )


def size_filter(sources: DataFrame, max_file_bytes: int = 2 << 20) -> DataFrame:
    return sources.where(F.col("len_bytes") <= max_file_bytes)


def byte_budget(sources: DataFrame, max_total: int, max_file_bytes: int = 2 << 20) -> DataFrame:
    """Sources, by path, up to the first that no longer fits the total."""
    eligible = size_filter(sources, max_file_bytes)
    before = running_sum(eligible.select("source_id", "path", "len_bytes"), [F.split("path", "/"), F.col("source_id")], "len_bytes", "__before")
    fits = before.where(F.col("__before") + F.col("len_bytes") <= max_total).select("source_id", (F.col("__before") + F.col("len_bytes")).alias("cum_bytes"))
    return eligible.join(fits, "source_id")


def glob_regex(pattern: str) -> str:
    """A glob as a Java and RE2 regex; ``*`` crosses slashes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            body = pattern[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            k = end
        elif c == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out += "(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[k + 1 : end].split(",")) + ")"
            k = end
        else:
            out += "\\" + c if c in ".^$+()|\\{}[]" else c
        k += 1
    return f"^{out}$"


def glob_filter(sources: DataFrame, patterns: list[str]) -> DataFrame:
    if not patterns:
        return sources
    keep = F.lit(False)
    for p in patterns:
        keep = keep | F.col("path").rlike(glob_regex(p))
    return sources.where(keep)


def line_starts(text: Column) -> Column:
    """Byte offsets of lines: 0 and every place behind a newline."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sizes, zero, lambda a, s: F.struct((a["at"] + s).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def line_index(sources: DataFrame) -> DataFrame:
    """(source_id, line, start_byte, end_byte): lines from 1; an end behind the newline."""
    starts = sources.select("source_id", "len_bytes", line_starts(F.col("text")).alias("starts"))
    rows = starts.select("source_id", "len_bytes", "starts", F.posexplode("starts").alias("k", "start_byte"))
    following = F.when(F.col("k") + 1 < F.size("starts"), F.get("starts", F.col("k") + 1)).otherwise(F.col("len_bytes"))
    return rows.select("source_id", (F.col("k") + 1).cast("int").alias("line"), "start_byte", following.alias("end_byte"))


def byte_to_line(starts: Column, at: Column, length: Column) -> Column:
    """The line of a byte, up to and including the length; null past it."""
    return F.when((at >= 0) & (at <= length), F.size(F.filter(starts, lambda s: s <= at)))


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """Text of bytes [start, end)."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
