"""Position-preserving chunks: a sequential planner for each source, in Arrow batches.

A text becomes prefix sums of its characters' bytes, token starts and visible characters, by array operations; for the built-in token
estimate each step of the planner is then a few binary searches. A caller's counter takes the slow way.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import dropwhile, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.text import WHITE_SPACE
from tidepool.plans.ranking import running_sum
from tidepool.plans.store import written
from tidepool.shipping import ship

SCHEMA = "source_id long, path string, start_byte long, end_byte long, start_line int, end_line int, kind string, passage string"
_BLANK = frozenset(WHITE_SPACE)
_CJK = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 160
    overlap_tokens: int = 32
    max_lines: int = 40
    max_bytes: int = 1024

    def __post_init__(self):
        if min(self.target_tokens, self.max_lines, self.max_bytes) < 1:
            raise ValueError("chunk limits must be at least 1")
        if not 0 <= self.overlap_tokens <= 32 or self.overlap_tokens >= self.target_tokens:
            raise ValueError("overlap must be at most 32 and below the target")


def _alnum(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c)[0] in "LN"


def _kind(c: str) -> int:
    """0: white space, 1: part of a word, 2: a token by itself."""
    if c in _BLANK:
        return 0
    if _alnum(c) and not any(a <= ord(c) <= b for a, b in _CJK):
        return 1
    return 2


_UNKNOWN = 255
_kinds = np.full(0x110000, _UNKNOWN, np.uint8)


def kinds(points: np.ndarray) -> np.ndarray:
    """The kind of each code point; a table remembers those that have come up."""
    out = _kinds[points]
    new = points[out == _UNKNOWN]
    if len(new):
        for p in set(new.tolist()):
            _kinds[p] = _kind(chr(p))
        out = _kinds[points]
    return out


class Text:
    """A text with prefix sums over its characters: bytes, token starts and visible characters; and its lines."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n = n = len(points)
        kind = kinds(points)
        sums = np.zeros((3, n + 1), np.int64)
        part = kind == 1
        self.word = np.zeros(n, bool)  # inside a word, behind its first character
        self.word[1:] = part[1:] & part[:-1]
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=sums[0, 1:])
        np.cumsum((kind == 2) | (part & ~self.word), out=sums[1, 1:])
        np.cumsum(kind != 0, out=sums[2, 1:])
        self.bytes, self.tokens, self.visible = sums
        self.open = self.tokens[:-1] - self.word  # tokens before a character, less the one that it continues
        self.starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
        ends = np.append(self.starts[1:], n)  # behind a last newline there is an empty, blank line
        self.ends = np.unique(ends)
        self.blank = np.unique(ends[self.visible[ends] == self.visible[self.starts]])
        self.white = np.flatnonzero(kind == 0) + 1  # ends behind white space

    def is_blank(self, a: int, b: int) -> bool:
        return bool(self.visible[a] == self.visible[b])

    def line(self, at: int) -> int:
        """The line of a character, from 1."""
        return int(self.starts.searchsorted(at, "right"))

    def count(self, a: int, b: int) -> int:
        return int(self.tokens[b] - self.open[a]) if a < b else 0


def _last(ends: np.ndarray, after: int, most: int) -> int | None:
    """The last of sorted ends in (after, most]."""
    k = int(ends.searchsorted(most, "right"))
    return int(ends[k - 1]) if k and ends[k - 1] > after else None


def plan(text: str, config: ChunkConfig = ChunkConfig(), counter: Callable[[str], int] | None = None, most: int | None = None) -> Iterator[tuple[int, int, str, Text]]:
    """(start, end, kind, text) of each chunk, in characters; at most ``most``."""
    t = Text(text)
    count = None if counter is None else lambda a, b: counter(text[a:b])
    start = covered = made = 0
    while start < t.n and not t.is_blank(start, t.n):
        limit = _limit(t, start, config)
        found = _line_end(t, start, covered, limit, config, count)
        if found is None and start < covered:
            start = covered
            continue
        end, kind = found or (_character_end(t, start, limit, config, count), "long_line")
        if not t.is_blank(start, end):
            if made == most:
                return
            made += 1
            yield start, end, kind, t
        covered = end
        start = _restart(t, start, end, config, count)


def _limit(t: Text, start: int, config: ChunkConfig) -> int:
    """The furthest end by bytes and lines."""
    by_bytes = int(t.bytes.searchsorted(t.bytes[start] + config.max_bytes, "right")) - 1
    line = t.line(start) + config.max_lines - 1
    return min(by_bytes, int(t.starts[line]) if line < len(t.starts) else t.n)


def _fitting(t: Text, start: int, limit: int, config: ChunkConfig) -> int:
    """The furthest end by the token estimate too."""
    return min(limit, int(t.tokens.searchsorted(config.target_tokens + t.open[start], "right")) - 1)


def _line_end(t: Text, start: int, covered: int, limit: int, config: ChunkConfig, count) -> tuple[int, str] | None:
    after = max(start, covered)
    ends, blanks = t.ends, t.blank
    if count is None:
        limit = _fitting(t, start, limit, config)
    else:
        lo, hi = ends.searchsorted((after, limit), "right")
        ends = np.array([e for e in ends[lo:hi].tolist() if count(start, e) <= config.target_tokens], np.int64)
        blanks = np.intersect1d(ends, blanks)
    last = _last(ends, after, limit)
    if last is None:
        return None
    if t.starts[t.line(start) - 1] != start:
        return last, "long_line"
    blank = _last(blanks, after, limit)
    if blank is not None and not t.is_blank(start, blank):
        return blank, "paragraph"
    return last, "lines"


def _character_end(t: Text, start: int, limit: int, config: ChunkConfig, count) -> int:
    """The last end that fits, behind white space if any such one fits; one character at least."""
    if count is None:
        last = _fitting(t, start, limit, config)
        return start + 1 if last <= start else _last(t.white, start, last) or last
    fits = lambda end: count(start, end) <= config.target_tokens
    good = list(takewhile(fits, dropwhile(lambda end: not fits(end), range(start + 1, limit + 1))))
    white = set(t.white.tolist())
    return next((e for e in reversed(good) if e in white), good[-1] if good else start + 1)


def _restart(t: Text, start: int, end: int, config: ChunkConfig, count) -> int:
    """Where the overlap begins: as far before the end as its bytes and tokens allow; the end itself if that is the whole chunk."""
    if not config.overlap_tokens or end >= t.n:
        return end
    least = max(start, int(t.bytes.searchsorted(t.bytes[end] - config.max_bytes)))
    if count is None:
        best = min(max(least, int(t.open.searchsorted(t.tokens[end] - config.overlap_tokens))), end)
    else:
        back = takewhile(lambda a: count(a, end) <= config.overlap_tokens, range(end - 1, least - 1, -1))
        best = next(iter(deque(back, maxlen=1)), end)
    return end if best <= start else best


_NAMES = ["source_id", "path", "start_byte", "end_byte", "start_line", "end_line", "kind", "passage"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def chunk(sources: DataFrame, config: ChunkConfig = ChunkConfig(), counter: Callable[[str], int] | None = None, most_a_source: int | None = None) -> DataFrame:
    """Chunks of sources (source_id, path, text), without an index."""
    ship(sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for source_id, path, text in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    for a, b, kind, t in plan(text, config, counter, most_a_source):
                        rows.append((source_id, path, int(t.bytes[a]), int(t.bytes[b]), t.line(a), t.line(b - 1), kind, text[a:b]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _TYPES)], names=_NAMES)

    return sources.select("source_id", "path", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def number(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Adds chunk_index, from 0 in (source_id, start, end) order, and keeps the first ``most``.

    The chunks are written once, as planning them is what costs. Counts by source come first, so the running sum spans sources and no
    window holds all chunks.
    """
    chunks = written(chunks)
    sizes = chunks.groupBy("source_id").agg(F.count("*").alias("__n"))
    before = running_sum(sizes, [F.col("source_id")], "__n", "__before").select("source_id", "__before")
    if most is not None:
        before = before.where(F.col("__before") < most)
    out = chunks.join(before, "source_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("start_byte", "end_byte")) - 1
    out = out.withColumn("chunk_index", (F.col("__before") + place).cast("long")).drop("__before")
    return out if most is None else out.where(F.col("chunk_index") < most)


def limit_reached(chunks: DataFrame, most: int) -> bool:
    """Whether :func:`number` leaves out chunks; ``chunks`` are those before it."""
    return len(chunks.select("source_id").limit(most + 1).collect()) > most if most < 1000 else chunks.count() > most


def whole_documents(sources: DataFrame) -> DataFrame:
    """Each non-empty source as one chunk; its id is the index."""
    lines = F.size(F.split("text", "\n", -1))
    return sources.where("text <> ''").select(
        F.col("source_id").alias("chunk_index"), "source_id", "path", F.lit(0).cast("long").alias("start_byte"), F.col("len_bytes").alias("end_byte"),
        F.lit(1).alias("start_line"), lines.alias("end_line"), F.lit("lines").alias("kind"), F.col("text").alias("passage"),
    )
