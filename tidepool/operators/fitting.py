"""Splits chunks until query and passage fit a pair limit; passages are independent, so Spark tasks are the parallelism."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import WHITE_SPACE
from tidepool.operators import contracts
from tidepool.plans.ranking import running_sum
from tidepool.plans.store import written
from tidepool.shipping import ship

_BLANK = np.array([ord(c) for c in WHITE_SPACE])


class PairTooLong(ValueError):
    """One character with the query is beyond the pair limit."""


class Passage:
    """A passage with the byte offsets of its characters, and where it may part: behind newlines and behind white space."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n = len(points)
        self.bytes = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        newline, white = points == 10, np.isin(points, _BLANK)
        white[:-1] &= ~((points[:-1] == 13) & newline[1:])
        self.lines = np.cumsum(newline)
        self.behind = np.flatnonzero(newline) + 1, np.flatnonzero(white) + 1

    def middle(self, a: int, b: int) -> int | None:
        """Where characters [a, b) part: of the places within a quarter of their bytes from the middle the nearest one behind a newline,
        else behind white space, else the nearest character's end. Of two as near, the first."""
        if b - a < 2:
            return None
        size = int(self.bytes[b] - self.bytes[a])
        middle, reach = int(self.bytes[a]) + size // 2, size // 4
        lo, hi = int(self.bytes.searchsorted(middle - reach)), int(self.bytes.searchsorted(middle + reach, "right"))
        for places in self.behind:
            p = places[places.searchsorted(max(lo, a + 1)) : places.searchsorted(min(hi, b))]
            if len(p):
                return int(p[np.abs(self.bytes[p] - middle).argmin()])
        at = int(self.bytes.searchsorted(middle))
        near = np.arange(max(at - 1, a + 1), min(at + 1, b - 1) + 1)
        near = near if len(near) else np.array([a + 1])
        return int(near[np.abs(self.bytes[near] - middle).argmin()])


def split_place(text: str) -> int | None:
    """Where a whole passage parts, in characters."""
    return Passage(text).middle(0, len(text))


def fit_passage(passage: Passage | str, count: Callable[[str], int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of characters, from left to right, that fit."""
    if isinstance(passage, str):
        passage = Passage(passage)
    pending = [(0, passage.n)]
    while pending:
        a, b = pending.pop()
        if count(passage.text[a:b]) <= limit:
            yield a, b
            continue
        place = passage.middle(a, b)
        if place is None:
            raise PairTooLong(f"one character at {a} takes more than {limit} tokens with the query")
        pending += [(place, b), (a, place)]


def fit(chunks: DataFrame, query: str, limit: int, pair_count: Callable[[str, str], int]) -> DataFrame:
    """``chunks`` with passages, split where needed; adds ``pieces``: the number of parts of the chunk it comes from."""
    if limit < 1:
        raise ValueError("the pair limit must be at least 1")
    ship(chunks.sparkSession)
    names = chunks.columns
    own = {"start_byte", "end_byte", "start_line", "end_line", "passage"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first_byte, first_line = (batch.column(names.index(c)).to_pylist() for c in ("passage", "start_byte", "start_line"))
            rows: list[tuple] = []
            for k, text in enumerate(texts):
                p = Passage(text)
                parts = list(fit_passage(p, lambda x: pair_count(query, x), limit))
                for a, b in parts:
                    before = first_line[k] + (int(p.lines[a - 1]) if a else 0)
                    last = first_line[k] + (int(p.lines[b - 2]) if b > 1 else 0)
                    rows.append((k, first_byte[k] + int(p.bytes[a]), first_byte[k] + int(p.bytes[b]), before, last, text[a:b], len(parts)))
            if not rows:
                continue
            at, *found, pieces = zip(*rows)
            made = dict(zip(("start_byte", "end_byte", "start_line", "end_line", "passage"), found))
            same = batch.take(pa.array(at))
            columns = [pa.array(made[c], same.schema.field(k).type) if c in own else same.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.int32())], names=[*names, "pieces"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{fields}, pieces int")


def fit_all(
    sources: DataFrame, chunks: DataFrame, query: str, limit: int, most: int, pair_count: Callable[[str, str], int]
) -> tuple[DataFrame, int, bool]:
    """(passages, split_count, limit_reached): :func:`fit` of validated chunks, in (source, start, end) order, ``most`` at most.

    Chunks that break their contract are an error before anything is counted. The cap is shared: a source's passages have a place behind
    those of all sources before it. ``split_count`` has the chunks that were split and of which a part is kept.
    """
    if most < 1:
        raise ValueError("the cap on chunks must be at least 1")
    contracts.require(contracts.chunk_problems(sources, chunks), "chunks don't fit their sources")
    order = [F.col("source_id"), F.col("start_byte"), F.col("end_byte")]
    first = written(chunks.withColumn("__chunk", F.struct("source_id", "start_byte", "end_byte", F.monotonically_increasing_id().alias("n"))))
    fitted = written(fit(first, query, limit, pair_count))
    placed = running_sum(fitted.select("__chunk", *order, F.lit(1).cast("long").alias("__one")), [F.col("__chunk"), *order], "__one", "__place")
    kept = written(placed.where(F.col("__place") < most).select("__chunk", F.col("start_byte").alias("__start"), "__place"))
    out = fitted.join(kept, ["__chunk"]).where(F.col("start_byte") == F.col("__start"))
    counts = out.select("__chunk", "pieces").distinct().agg(F.count(F.when(F.col("pieces") > 1, 1)).alias("split")).first()
    reached = fitted.count() > kept.count()
    return out.withColumn("chunk_index", F.col("__place")).drop("__chunk", "__start", "__place"), counts["split"], reached
