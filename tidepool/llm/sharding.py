"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition, overfull ranges split.

A record's key is (hash of its text, hash of its id): equal texts are neighbours. Records are drawn with a chance in
proportion to their size; quantiles of the drawn keys cut the key space into ranges of about equal bytes, whose
exact sizes one aggregation counts. Ranges above ``OVERFULL`` of a shard are subdivided: by new samples from them, and
where one text alone overfills a range, by the ids of its copies. Neighbouring ranges then form the shards. The law
is ``bytes``: shards' sizes differ from their mean by about ``OVERFULL`` at most, or by one record that is larger.

All on DataFrame functions. Only splitters, at most ``MOST_SAMPLES`` drawn keys, and counts by range reach the driver;
texts are read once and reduced to (id, size, crc, key) in a table in the shared folder. A slot is the record's place in its
range behind the rows of the shard's earlier ranges, so no window spans a shard.

Defined results: a null text has size 1, the crc of no bytes and the key of null; equal texts share a shard unless their
copies alone overfill a range; repeated rows and equal keys get different slots in any order; an empty table
gives an empty result; columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm._shared import written

RANGES = 1024
RANGE_BYTES = 256 << 20
MOST_SAMPLES = 200_000
SAMPLES_A_RANGE = 24
OVERFULL = 0.01
ROUNDS = 6
_LOWEST = -(1 << 63)
_SPAN = 1 << 32

Splitter = tuple[int, int]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, key, salt, draw); ``draw`` is a place in [0, 2^32) that depends on the record alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.xxhash64(F.col(id_col), F.lit(1))
    return df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(F.col(text_col)).alias("key"),
        salt.alias("salt"),
        F.pmod(F.xxhash64(salt, F.lit(2)), F.lit(_SPAN)).alias("draw"),
    )


def range_of(splitters: list[Splitter]) -> Column:
    """The number of splitters at or below (key, salt): a binary search, folded over the powers of two."""
    if not splitters:
        return F.lit(0)
    keys = "array(" + ",".join(f"{k}L" if k > _LOWEST else f"({k + 1}L - 1L)" for k, _ in splitters) + ")"
    salts = "array(" + ",".join(f"{s}L" if s > _LOWEST else f"({s + 1}L - 1L)" for _, s in splitters) + ")"
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    n = len(splitters)
    return F.expr(
        f"aggregate(array({','.join(map(str, steps))}), 0, (a, s) -> CASE WHEN a + s <= {n} AND "
        f"(element_at({keys}, least(a + s, {n})) < key OR (element_at({keys}, least(a + s, {n})) = key AND element_at({salts}, least(a + s, {n})) <= salt)) "
        "THEN a + s ELSE a END)"
    )


def _quantiles(drawn: list[tuple[int, int, int]], parts: int, by_salt: bool) -> list[Splitter]:
    """Keys that cut weighted, sorted samples (key, salt, weight) into ``parts`` of equal weight."""
    drawn = sorted(drawn)
    total, got, out, k = sum(w for *_, w in drawn), 0, [], 1
    for key, salt, weight in drawn:
        got += weight
        while k < parts and got * parts > total * k:
            out.append((key, salt if by_salt else _LOWEST))
            k += 1
    return out


def _draw(table: DataFrame, bytes_a_sample: float) -> DataFrame:
    """Samples (key, salt, weight): a record of size s counts s / bytes_a_sample times, a part of one by chance."""
    expected = F.col("size") / F.lit(float(bytes_a_sample))
    weight = F.floor(expected) + (F.col("draw") / _SPAN < expected - F.floor(expected)).cast("long")
    return table.withColumn("weight", weight).where("weight > 0")


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", overfull: float = OVERFULL) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless from 0)."""
    table = written(keyed(df, id_col, text_col))
    rows, total = table.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return _out(table.withColumn("range", F.lit(0)), id_col, [0], [0])
    ranges = int(min(max(RANGES, shards * 16, total // RANGE_BYTES), MOST_SAMPLES // SAMPLES_A_RANGE))
    most = overfull * total / shards
    drawn = _draw(table, total / (ranges * SAMPLES_A_RANGE)).select("key", "salt", "weight").collect()
    splitters = sorted(set(_quantiles([tuple(r) for r in drawn], ranges, False)))
    for turn in range(ROUNDS):
        counted = table.groupBy(range_of(splitters).alias("range")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"),
            F.min("salt").alias("s0"), F.max("salt").alias("s1"),
        ).collect()
        large = {r["range"]: r for r in counted if r["bytes"] > most and (r["lo"], r["s0"]) != (r["hi"], r["s1"])}
        if not large or turn == ROUNDS - 1:
            break
        inside = sum(r["bytes"] for r in large.values())
        parts = {k: min(int(r["bytes"] // most) * 2 + 2, 4 * ranges) for k, r in large.items()}
        a_sample = max(inside / (SAMPLES_A_RANGE * sum(parts.values())), 1e-9)
        numbered = table.withColumn("range", range_of(splitters)).where(F.col("range").isin(list(large)))
        found: dict[int, list] = {}
        for r in _draw(numbered, a_sample).select("range", "key", "salt", "weight").collect():
            found.setdefault(r["range"], []).append((r["key"], r["salt"], r["weight"]))
        new = set(splitters)
        for k, got in found.items():
            heavy: dict[int, int] = {}
            for key, _, weight in got:
                heavy[key] = heavy.get(key, 0) + weight
            new |= set(_quantiles(got, parts[k], False))
            # a text whose copies alone overfill a range: cut before and behind it, and among its copies
            for key, weight in heavy.items():
                if weight * a_sample > most * 0.8:
                    new |= {(key, _LOWEST), (key + 1, _LOWEST)} if key < (1 << 63) - 1 else {(key, _LOWEST)}
                    new |= set(_quantiles([x for x in got if x[0] == key], max(2, int(weight * a_sample // most) * 2 + 2), True))
        if new == set(splitters):
            break
        splitters = sorted(new)
    sizes = sorted((r["range"], r["bytes"], r["rows"]) for r in counted)
    shard_of, first_slot = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    got, filled = 0, [0] * shards
    for number, size, count in sizes:
        at = min(shards - 1, int((got + size / 2) * shards / total))
        shard_of[number], first_slot[number] = at, filled[at]
        filled[at] += count
        got += size
    return _out(table.withColumn("range", range_of(splitters)), id_col, shard_of, first_slot)


def _out(table: DataFrame, id_col: str, shard_of: list[int], first_slot: list[int]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", "salt", "id"))
    shards = F.expr(f"element_at(array({','.join(map(str, shard_of))}), range + 1)")
    first = F.expr(f"element_at(array({','.join(f'{x}L' for x in first_slot)}), range + 1)")
    return table.withColumn("place", place).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), shards.cast("int").alias("shard"), (first + F.col("place") - 1).cast("long").alias("slot")
    )
