"""Made corpora, digests of corpora, and staleness of snapshots."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The benchmark corpus's file contents and the distractors' line.
TEMPLATE = (
    "pub fn retry_delay(attempt: u32) -> u64 {\n    let bounded = attempt.min(8);\n    250_u64.saturating_mul(1_u64 << bounded)\n}\n\n"
    "pub fn request_timeout() -> u64 { 30 }\n\n"
)
DISTRACTOR = "Field note %04d: the archive lists color swatches, room names, and material weights.\n"


def benchmark_corpus(spark: SparkSession, files: int = 1000, total_bytes: int = 10 << 20) -> DataFrame:
    """(source_id, path, text): files of one repeated template, of equal size but for the bytes that are left over."""
    if files < 1 or total_bytes < files:
        raise ValueError("each file needs at least one byte")
    size = F.lit(total_bytes // files) + (F.col("id") < total_bytes % files).cast("int")
    whole = F.repeat(F.lit(TEMPLATE), (total_bytes // files) // len(TEMPLATE) + 1)
    return spark.range(files).select(F.col("id").alias("source_id"), F.format_string("module-%04d.rs", "id").alias("path"), F.substr(whole, F.lit(1), size).alias("text"))


def with_distractors(sources: DataFrame, additional: int = 240) -> DataFrame:
    """``sources`` (path, text) and neutral one-line files, enough of them to make candidates matter."""
    if additional < 129:
        raise ValueError("at least 129 distractors are needed for candidates to be left out")
    made = sources.sparkSession.range(additional).select(F.format_string("distractors/extra-%04d.txt", "id").alias("path"), F.format_string(DISTRACTOR, "id").alias("text"))
    return sources.select("path", "text").unionByName(made)


def inventory(sources: DataFrame) -> DataFrame:
    """(path, sha256) of each source."""
    return sources.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def framed(path: Column, content: Column) -> Column:
    """A file's part of a corpus digest: the path's length in eight bytes, the path, the content's length, the content."""
    eight = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    return F.concat(eight(F.octet_length(path)), F.encode(path, "UTF-8"), eight(F.octet_length(content)), content)


def corpus_digest(sources: DataFrame) -> str:
    """SHA-256 over all files (path, text or content) by path. A digest is a fold, so files stream through the driver, one partition at a time."""
    content = F.col("content") if "content" in sources.columns else F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    digest = hashlib.sha256()
    for row in sources.select(F.split("path", "/").alias("p"), framed(F.col("path"), content).alias("x")).orderBy("p").select("x").toLocalIterator():
        digest.update(row.x)
    return digest.hexdigest()


def changed_on_disk(path: str, text: str | bytes) -> bool:
    """Whether a file no longer has what was read, or can't be read any more."""
    want = text.encode() if isinstance(text, str) else text
    try:
        if os.path.getsize(path) != len(want):
            return True
        with open(path, "rb") as f:
            return f.read() != want
    except OSError:
        return True
