"""Candidate selection by quotas: body, path, neighbours of hits, and diverse chunks, filled in this order.

Each list is a top-k plan; a prefix of ``limit`` rows of each is all that filling needs, so at most six times
``limit`` ids reach the driver, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.operators.lexical import ranking_order
from tidepool.plans.ranking import bisect_depth, global_rank, spread_key

SHARES = {"body": 5, "path": 1, "neighbours": 1, "diverse": 1}


def quota(limit: int) -> dict[str, int]:
    """``limit`` by 5:1:1:1 with largest remainders, ties to the earlier category."""
    if limit < 1:
        raise ValueError("the candidate limit must be at least 1")
    whole = sum(SHARES.values())
    out = {c: limit * s // whole for c, s in SHARES.items()}
    remainders = sorted(SHARES, key=lambda c: -(limit * SHARES[c] % whole))  # stable
    for c in remainders[: limit - sum(out.values())]:
        out[c] += 1
    return out


def chunk_order() -> list[Column]:
    return [F.split("path", "/"), F.col("start_byte"), F.col("end_byte"), F.col("source_id"), F.col("chunk_index")]


def neighbours(chunks: DataFrame, scored: DataFrame) -> DataFrame:
    """(chunk_index, hit_index, side) of the chunks before (0) and behind (1) each hit in its source."""
    w = Window.partitionBy("source_id").orderBy("start_byte", "end_byte", "chunk_index")
    both = chunks.select("source_id", "chunk_index", F.lag("chunk_index").over(w).alias("p"), F.lead("chunk_index").over(w).alias("n"))
    hits = both.join(scored.where("score > 0").select("chunk_index", "score", "body_score", "path_score"), "chunk_index")
    rows = hits.select(F.col("chunk_index").alias("hit_index"), "score", "body_score", "path_score", F.posexplode(F.array("p", "n")).alias("side", "chunk_index"))
    return rows.where("chunk_index IS NOT NULL")


def midpoints(chunks: DataFrame) -> DataFrame:
    """Adds midpoint_rank: the place of a chunk when its source's chunks are visited by halves."""
    every = Window.partitionBy("source_id")
    placed = chunks.withColumn("__n", F.count("*").over(every)).withColumn("__k", F.row_number().over(every.orderBy("start_byte", "end_byte", "chunk_index")) - 1)
    placed = placed.withColumn("__d", bisect_depth(F.col("__k"), F.lit(0), F.col("__n")))
    return placed.withColumn("midpoint_rank", (F.row_number().over(every.orderBy("__d", "__k")) - 1).cast("long")).drop("__n", "__k", "__d")


def spread(sources: DataFrame) -> DataFrame:
    """(source_id, spread_rank) of sources (source_id, path), visited first, last, then by halves."""
    placed = global_rank(sources.select("source_id", "path").distinct(), [F.split("path", "/"), F.col("source_id")], "__k")
    n = placed.agg(F.count("*").alias("__n"))
    keyed = placed.crossJoin(F.broadcast(n)).withColumn("__d", spread_key(F.col("__k"), F.col("__n")))  # one row
    return global_rank(keyed, [F.col("__d"), F.col("__k")], "spread_rank").select("source_id", "spread_rank")


def diverse(chunks: DataFrame) -> DataFrame:
    """``chunks`` with midpoint_rank and spread_rank; ordered by both they go round all sources."""
    return midpoints(chunks).join(spread(chunks), "source_id")


@dataclass
class Selection:
    indexes: list[int]
    counts: dict[str, int] | None = None
    quota: dict[str, int] | None = None
    order: dict[int, int] = field(default_factory=dict)


def select(chunks: DataFrame, scored: DataFrame, limit: int, total: int | None = None) -> Selection:
    """The chosen chunk indexes in selection order; all of them, in order, where they are no more than ``limit``."""
    first = [r.chunk_index for r in chunks.select("chunk_index").orderBy("chunk_index").limit(limit + 1).collect()] if total is None or total <= limit else []
    if first and len(first) <= limit:
        return Selection(first)

    near = neighbours(chunks, scored)
    best = Window.partitionBy("chunk_index").orderBy(F.desc("score"), F.desc("body_score"), F.desc("path_score"), "hit_index", "side")
    near = near.withColumn("__r", F.row_number().over(best)).where("__r = 1")
    by_field = lambda name: (scored.where(F.col(name) > 0), [F.desc(name), *chunk_order()])
    tops = {
        "body": by_field("body_score"), "path": by_field("path_score"),
        "neighbours": (near, [F.desc("score"), F.desc("body_score"), F.desc("path_score"), F.col("hit_index"), F.col("side")]),
        "diverse": (diverse(chunks), [F.col("midpoint_rank"), F.col("spread_rank"), F.col("chunk_index")]),
        "hits": (scored.where("score > 0"), ranking_order()),
    }
    asked = [  # one job; each list is a top-k plan, numbered once it has ``limit`` rows
        df.orderBy(*order).limit(limit).select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("place"), "chunk_index") for name, (df, order) in tops.items()
    ]
    lists: dict[str, list[int]] = {name: [] for name in tops}
    for row in sorted(reduce(DataFrame.unionByName, asked).collect(), key=lambda r: r["place"]):
        lists[row["list"]].append(row["chunk_index"])
    hits, rounds = lists.pop("hits"), lists["diverse"]
    wanted, counts, chosen = quota(limit), {}, {}
    for name, found in lists.items():
        took = [i for i in found if i not in chosen][: wanted[name]]
        counts[name] = len(took)
        chosen |= dict.fromkeys(took)
    for found in (hits, rounds):
        chosen |= dict.fromkeys([i for i in found if i not in chosen][: limit - len(chosen)])
    return Selection(list(chosen), counts, wanted, {i: k for k, i in enumerate(chosen)})
