"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets and union-find grouping.

SuperMinHash gives each element the ranks of one random permutation of the signature's places, so an element's
values are correlated and the estimate's variance is lower than with independent hashes. Round ``j`` gives every
element still needed the value ``j + r``; once all places of a document hold less than ``j + 1``, later rounds can't
change them and stop.

The job, without an unbounded group in any task or on the driver:

1. One scan makes, for each document, its set's size, a 128-bit fingerprint, bands of its signature and a
   parity sketch; texts are not shuffled. Equal sets then form classes (a map-side combined minimum), so copies are
   never paired.
2. Each bucket of a band links its classes to two centres, its smallest members by two orders: a linear number of
   pairs, confirmed on full sets. Confirmed links are grouped.
3. Pairs of a bucket that are still in different groups are joined by size class, a large bucket's in salted parts; the
   sketch's lower bound on the symmetric difference and the size bound (both exact) leave the few that could link, and these
   are confirmed on full sets. So no link of a bucket is lost, however the centres fell.
4. Groups come from rounds of alternating large-star and small-star steps over the confirmed links,
   each round written to the shared folder.

With 20 bands of 4 values a pair at similarity 0.85 is missed with probability 4e-7, at 0.9 with 2e-10.

Defined results: null, empty and word-less texts have an empty set, are linked with nothing and kept; with fewer words
than a shingle the whole sequence is the one shingle; equal texts form one class; the nodes are classes, so rows that share
an id but not the text, or have no id, are rows of their own; a null id is a component only if its whole group has none; an
empty table gives an empty result; columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.shipping import ship
from tidepool.llm._shared import drop, written
from tidepool.llm._words import NONSPACE, U64, Words, blocks, group_sums, mix, shingles, sorted_distinct

BANDS, ROWS = 20, 4
#: Members of a bucket are gathered in so many parts; pairs of a larger bucket are dealt out in parts of ``HOT`` members.
SALTS = 64
HOT = 1024
SKETCH_BITS = 2048
_GOLDEN = 0x9E3779B97F4A7C15
GOLDEN = U64(_GOLDEN)


def super_minhash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures, (groups, size), of groups of element hashes; ``at`` has their starts and the end.

    A value is ``round << 56 | fraction``. Empty groups keep the largest value throughout.
    """
    groups = len(at) - 1
    out = np.full(groups * size, np.iinfo(U64).max, U64)
    owner = np.repeat(np.arange(groups), np.diff(at))

    def draw(h: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(h + U64((j + 1) * _GOLDEN % (1 << 64)))
        place = j + ((x >> U64(32)) * U64(size - j) >> U64(32)).astype(np.int64)
        return place, (U64(j) << U64(56)) | (mix(x) >> U64(8))

    place, value = draw(hashes, 0)
    np.minimum.at(out, owner * size + place, value)
    table = out.reshape(groups, size)
    open_ = np.diff(at) > 0
    kept = order = None
    for j in range(1, size):
        open_ &= table.max(axis=1) >= U64(j) << U64(56)
        if not open_.any():
            break
        if kept is None:
            kept = np.flatnonzero(open_[owner])
            order = np.tile(np.arange(size, dtype=np.uint16), (len(kept), 1))
            first = place[kept]
            order[np.arange(len(kept)), first] = 0
            order[:, 0] = first
        else:
            still = open_[owner[kept]]
            kept, order = kept[still], order[still]
        place, value = draw(hashes[kept], j)
        rows = np.arange(len(kept))
        slot = order[rows, place]
        order[rows, place] = order[:, j]
        order[:, j] = slot
        np.minimum.at(out, owner[kept] * size + slot, value)
    return table


def _signer(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column(1)):
                words = Words(raw, offsets, NONSPACE)
                grams, at = shingles(words.hash, words.first, size)
                signature = super_minhash(grams, at, bands * rows).reshape(hi - lo, bands, rows)
                band = np.full((hi - lo, bands), 0, U64)
                for k in range(rows):
                    band = mix(band * GOLDEN + signature[:, :, k])
                band = mix(band + np.arange(1, bands + 1, dtype=U64) * GOLDEN)
                values, ends = sorted_distinct(grams, at)
                n = np.diff(ends)
                high = mix(values ^ U64(0x5851F42D4C957F2D))
                owner = np.repeat(np.arange(hi - lo), n)
                bits = np.bincount(owner * SKETCH_BITS + (high >> U64(64 - 11)).astype(np.int64), minlength=(hi - lo) * SKETCH_BITS) & 1
                sketch = np.packbits(bits.astype(np.uint8)).reshape(hi - lo, SKETCH_BITS // 8).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(group_sums(mix(values), ends).view(np.int64)),
                        pa.array(group_sums(high, ends).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands), pa.int32()), pa.array(band.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * (SKETCH_BITS // 64) + 1, SKETCH_BITS // 64), pa.int32()), pa.array(sketch.ravel())),
                    ],
                    names=["id", "th", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    return run


@lru_cache(maxsize=64)
def _set_of(text: str, size: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]), NONSPACE)
    return np.unique(shingles(words.hash, words.first, size)[0])


def _confirmer(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for x, y in zip(a, b):
                x, y = _set_of(x, size), _set_of(y, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough; ``texts`` has id and text, once an id."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirmer(size, percent), f"a {_type(pairs, 'a')}, b {_type(pairs, 'b')}")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): each node's smallest reachable node. Union-find by star steps.

    A large-star step links a node's larger neighbours to its smallest neighbour, a small-star step its smaller
    ones and itself; rounds go on until neither changes a link. Only two sums reach the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        drop(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row per row: id, th (its text's hash), n_shingles and lead: the place (no id, id, th) of its group's first row."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    kind = _type(narrow, "id")
    signed = written(
        narrow.mapInArrow(_signer(size, bands, rows), f"id {kind}, th long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")
    )
    full = signed.where("n_shingles > 0")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    classes = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min(place).alias("rep")))
    entries = full.select(F.col("f1").alias("c"), F.col("n_shingles").alias("n"), "bands").dropDuplicates(["c"])
    entries = entries.select(F.struct("c", "n").alias("m"), F.explode("bands").alias("bucket"))
    parts = entries.groupBy("bucket", F.pmod(F.xxhash64("m.c"), F.lit(SALTS)).alias("salt")).agg(
        F.collect_list("m").alias("ms"), F.count("*").alias("members"), F.min("m.c").alias("c1"), F.min(F.xxhash64("m.c")).alias("h"), F.min_by("m.c", F.xxhash64("m.c")).alias("c2")
    )
    parts = written(parts)
    buckets = parts.groupBy("bucket").agg(F.sum("members").alias("members"), F.min("c1").alias("c1"), F.min_by("c2", "h").alias("c2")).where("members > 1")
    shared = parts.select("bucket", "ms").join(buckets, "bucket").select("bucket", "members", "c1", "c2", F.inline("ms"))
    shared = written(shared)
    drop(parts)
    involved = written(shared.select("c").distinct())
    first = classes.join(involved, F.col("f1") == F.col("c"), "left_semi").select("f1", "rep.id", "rep.th")
    first = first.select("f1", F.col("id").alias("i"), F.col("th").alias("t"))
    texts = narrow.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select(F.col("f1").alias("id"), "text")
    texts = written(texts.dropDuplicates(["id"]))
    star = shared.select("c", F.explode(F.array("c1", "c2")).alias("d")).where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
    sketched = written(full.join(involved, F.col("f1") == F.col("c"), "left_semi").select(F.col("f1").alias("c"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["c"]))
    links = written(confirm(_possible(star, sketched, percent), texts, size, percent))
    grouped = components(links)
    nodes = shared.select("bucket", "members", "c", "n").join(grouped.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    nodes = written(nodes)
    mixed = nodes.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ = written(nodes.join(mixed, "bucket", "left_semi").join(sketched.drop("n"), "c"))
    # sets that link differ by less than one size class; a larger bucket's pairs are dealt to one part for each HOT members
    scale = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent) + 1e-9))
    salts = F.ceil(F.col("members") / HOT).cast("int")
    x = open_.withColumn("scale", F.explode(F.array(scale - 1, scale, scale + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("x")
    y = open_.withColumn("scale", scale).withColumn("salt", F.pmod(F.xxhash64("c"), salts).cast("int")).alias("y")
    rest = x.join(
        y,
        F.expr(f"""x.bucket = y.bucket AND x.scale = y.scale AND x.salt = y.salt AND x.c < y.c AND x.component <> y.component
            AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
            AND {100 + percent} * {_distance('x.sketch', 'y.sketch')} <= {100 - percent} * (x.n + y.n)"""),
    ).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    final = written(components(links.unionByName(confirm(rest, texts, size, percent))))
    drop(open_, shared, nodes, sketched, involved, texts, links)
    labelled = classes.join(final.select(F.col("node").alias("f1"), "component"), "f1", "left").withColumn("component", F.coalesce("component", "f1"))
    leads = labelled.groupBy("component").agg(F.min("rep").alias("lead"))
    known = labelled.join(leads, "component").select("f1", "f2", "n_shingles", "lead")
    out = signed.select("id", "th", "n_shingles", "f1", "f2").join(known, ["f1", "f2", "n_shingles"], "left")
    return out.select("id", "th", "n_shingles", F.coalesce("lead", place).alias("lead"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id and kept (the row's id is its component's)."""
    found = _grouped(docs, id_col, text_col, size, percent, bands, rows)
    out = found.select(F.col("id").alias(id_col), "n_shingles", F.col("lead.id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _distance(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"


def _possible(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs that the sizes and the sketches (c, n, sketch), both exact bounds, leave possible."""
    x, y = (sketched.select(F.col("c").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"s{p}")) for p in "ab")
    both = pairs.join(x, "a").join(y, "b")
    return both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * {_distance('sa', 'sb')} <= {100 - percent} * (na + nb)").select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = 28) -> DataFrame:
    """``docs``, all columns, with one row of each group: that of the smallest id, and of its rows that of the smallest text hash.

    A row is known by id and text. Repeated rows (equal id and text) are copies too, so one of them stays; rows without a word all stay.
    """
    found = _grouped(docs, id_col, text_col, size, percent, bands, ROWS).where("n_shingles > 0")
    here = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    rows = found.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("__n"), F.first(here.eqNullSafe(F.col("lead"))).alias("__lead"))
    rows = written(rows.where("__n > 1 OR NOT __lead"))
    names = [f"__c{k}" for k in range(len(docs.columns))]
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    keyed = docs.toDF(*names)
    same = F.col(own).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    out = keyed.join(rows, same, "left_anti")
    again = rows.where("__lead")
    if again.take(1):
        one = keyed.join(again, same, "left_semi").withColumn("__th", F.xxhash64(text)).dropDuplicates([own, "__th"]).drop("__th")
        out = out.unionByName(one)
    return out.toDF(*docs.columns)
