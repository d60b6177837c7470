"""Lexical, fast and deep search over chunks, with overlap suppression and a report."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from time import perf_counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.operators import candidates, lexical, scoring
from tidepool.plans.store import written
from tidepool.shipping import ship

OVERLAP = 0.6


def _order(model: bool) -> list[Column]:
    return [F.desc("relevance_logit" if model else "score"), *candidates.chunk_order()]


class _Kept:
    """Kept spans of one source, by length in powers of two and sorted by start: tells whether one of them overlaps a span too much.

    Kept spans of like lengths hardly overlap each other, so few of them are near any place; a span that holds a shorter kept
    one as a whole is told by the first such.
    """

    def __init__(self, ratio: float):
        self.ratio = ratio
        self.classes: dict[int, list[tuple[int, int]]] = {}

    def covers(self, a: int, b: int) -> bool:
        for size, spans in self.classes.items():
            for k in range(bisect_right(spans, (a - (1 << size), -1)), len(spans)):
                x, y = spans[k]
                if x >= b:
                    break
                shortest = min(y - x, b - a)
                if shortest > 0 and max(min(y, b) - max(x, a), 0) / shortest >= self.ratio:
                    return True
        return False

    def add(self, a: int, b: int) -> None:
        insort(self.classes.setdefault((b - a).bit_length(), []), (a, b))


def suppress_overlaps(entries: DataFrame, order: list[Column], ratio: float = OVERLAP) -> DataFrame:
    """Entries that no better kept entry of their source overlaps by ``ratio`` of the shorter one.

    The greedy walk needs one source's spans alone, in rank order; three numbers of each travel to it.
    """
    ship(entries.sparkSession)
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    ranked = entries.withColumn("__rank", rank)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, _Kept(ratio)
        for batch in batches:
            good = []
            for source, _, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if source != now:
                    now, kept = source, _Kept(ratio)
                good.append(not kept.covers(a, b))
                if good[-1]:
                    kept.add(a, b)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    narrow = ranked.select("source_id", "__rank", F.col("start_byte").cast("long"), F.col("end_byte").cast("long")).where("source_id IS NOT NULL")
    kind = narrow.schema["source_id"].dataType.simpleString()
    kept = narrow.repartition("source_id").sortWithinPartitions("source_id", "__rank").mapInArrow(walk, f"source_id {kind}, __rank int")
    return ranked.join(kept, ["source_id", "__rank"], "left_semi").drop("__rank")


@dataclass
class Report:
    """What a search did. ``results`` has rank, the chunk's place, and the scores that the mode has."""

    mode: str
    results: DataFrame
    lexical_evidence: bool
    scoring_complete: bool | None
    deduplicated_count: int
    chunks_total: int
    chunks_evaluated: int
    selection: candidates.Selection | None = None
    timings_ms: dict[str, int] = field(default_factory=dict)


def search(
    chunks: DataFrame, query: str, mode: str = "lexical", top_k: int = 10, candidate_limit: int = 128,
    scorer: scoring.Scorer | None = None, score_column: Callable[[Column], Column] | None = None, batch_size: int = 1, digits: int | None = None,
) -> Report:
    """Searches numbered chunks (chunk_index, source_id, path, spans, passage).

    A model mode takes a :class:`~tidepool.operators.scoring.Scorer` or ``score_column``, a Catalyst expression of the passage.
    """
    if mode not in ("lexical", "fast", "deep") or top_k < 1:
        raise ValueError("mode must be lexical, fast or deep, and top_k at least 1")
    model = mode != "lexical"
    if model and scorer is None and score_column is None:
        raise ValueError(f"{mode} search needs a scorer")
    if not model and (scorer is not None or score_column is not None):
        raise ValueError("lexical search takes no scorer")
    took, began = {}, perf_counter()

    def lap(name: str) -> None:
        nonlocal began
        took[name], began = round(1000 * (perf_counter() - began)), perf_counter()

    # scores of all chunks, without text, are what all that follows reads
    every = written(lexical.score(chunks, query, digits=digits, keep_all=True))
    total, n_scored = every.agg(F.count("*"), F.count(F.when(F.col("score") > 0, 1))).first()
    scored = every.where("score > 0")
    lap("lexical")
    if not model:
        entries, n_entries, complete, chosen = scored, n_scored, None, None
    else:
        chosen = candidates.select(every, scored, candidate_limit, total) if mode == "fast" else None
        picked, n_entries = chunks, total
        if chosen is not None and total > candidate_limit:
            spark = chunks.sparkSession
            ids = spark.createDataFrame([(i,) for i in chosen.indexes], "chunk_index long")
            picked, n_entries = chunks.join(F.broadcast(ids), "chunk_index", "left_semi"), len(chosen.indexes)  # at most candidate_limit rows
        lap("selection")
        complete = mode == "deep" or total <= candidate_limit
        if score_column is not None:
            logits = picked.select("chunk_index", score_column(F.col("passage")).alias("relevance_logit"))
        else:
            logits = scoring.score(picked, query, scorer, batch_size)
        logits = written(logits)
        lap("inference")
        entries = logits.join(every, "chunk_index").withColumns({c: F.when(F.col("score") > 0, F.col(c)) for c in ("body_score", "path_score", "score")})
    kept = written(suppress_overlaps(entries, _order(model)))
    n_kept = kept.count()
    best = kept.orderBy(*_order(model)).limit(top_k)
    results = best.withColumn("rank", F.row_number().over(Window.orderBy(*_order(model))))  # top_k rows
    lap("ranking")
    return Report(mode, results, n_scored > 0, complete, n_entries - n_kept, total, n_entries, chosen, took)
