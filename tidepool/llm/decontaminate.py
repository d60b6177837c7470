"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training token windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``size`` consecutive words of
an item; an item of fewer words, but not none, is one window. Documents are scanned in place by ``mapInArrow``: rolling
64-bit hashes of all windows of a block go through a bitmap, then a binary search in the sorted hash set, and
each hit is verified against the window's words, so a collision can't mark a document. No document is shuffled.

Items are broadcast only in blocks of at most ``block_bytes`` of text, whose set takes about ten times as many bytes
in each worker. A larger benchmark is scanned block by block (a stated query set against all rows) in one chain, in which each row carries its hits of the blocks so far.

Defined results: null or empty texts and texts without words have n_words 0 and no hit; a null item text has no
window; items with a null id count for hits but are not listed; repeated items and ids are listed once; repeated
documents give repeated rows; an empty benchmark leaves all documents clean; columns other than id and text are not
read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tidepool.shipping import ship
from tidepool.llm._words import ALNUM, U64, Words, blocks, windows

SCHEMA = "id {id}, n_words long, hit_words array<int>, items array<string>, spans array<struct<start:long,end:long>>"
CARRIED = "id {id}, text string, hit_words array<int>, items array<string>"
BITMAP_BITS = 20


class WindowSet:
    """Windows of a block of items: by length, sorted distinct hashes, a window's place for each, and its items.

    Arrays beside the items' own bytes: about 40 bytes a word of the items. Windows of one hash and unlike words, should there be any,
    are told apart by their words.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.ids = [None if i is None else str(i) for i, _ in items]
        texts = [(text or "").encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.words = words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, ALNUM)
        counts = words.counts()
        row = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(row))
        self.lengths = {}
        for length in np.unique(np.minimum(counts[counts > 0], size)).tolist():
            whole = counts[row] >= size if length == size else counts[row] == length
            at = place[whole & (place + length <= words.first[row + 1])]
            hashes = windows(words.hash, length)[at]
            order = np.lexsort((at, hashes))
            at, hashes = at[order], hashes[order]
            new = np.ones(len(at), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            others: dict[int, dict[bytes, set[int]]] = {}
            alike = np.ones(len(at), bool)
            for k in np.flatnonzero(~new).tolist():
                if self._name(at[k], length) != self._name(at[first[k]], length):
                    alike[k] = False
                    others.setdefault(int(hashes[k]), {}).setdefault(self._name(at[k], length), set()).add(int(row[at[k]]))
            owner = row[at]
            once = alike.copy()  # an item once for each window
            once[1:] &= new[1:] | (owner[1:] != owner[:-1])
            starts = np.concatenate([[0], np.cumsum(once)])[np.concatenate([np.flatnonzero(new), [len(at)]])]
            bitmap = np.zeros(1 << BITMAP_BITS, bool)
            bitmap[hashes[new] >> U64(64 - BITMAP_BITS)] = True
            self.lengths[length] = (hashes[new], bitmap, at[new], starts, owner[once].astype(np.int32), others)

    def _name(self, at: int, length: int) -> bytes:
        return b" ".join(self.words.text(i) for i in range(at, at + length))

    def scan(self, words: Words) -> Iterator[tuple[int, int, tuple]]:
        """(first word, words, a window's mark) of each verified window, wherever it stands in a block."""
        for length, (hashes, bitmap, place, _, _, others) in self.lengths.items():
            rolling = windows(words.hash, length)
            at = np.flatnonzero(bitmap[rolling >> U64(64 - BITMAP_BITS)])
            if not len(at):
                continue
            near = np.minimum(np.searchsorted(hashes, rolling[at]), len(hashes) - 1)
            at, near = at[hashes[near] == rolling[at]], near[hashes[near] == rolling[at]]
            row = np.searchsorted(words.first, at, "right") - 1
            inside = at + length <= words.first[row + 1]
            for k, number in zip(at[inside].tolist(), near[inside].tolist()):
                name = b" ".join(words.text(i) for i in range(k, k + length))
                if name == self._name(place[number], length):
                    yield k, length, (length, number, None)
                elif name in others.get(int(hashes[number]), ()):
                    yield k, length, (length, number, name)

    def items(self, marks: set[tuple]) -> set[str]:
        """The ids, where there are any, of the items that have one of the windows."""
        out: set[int] = set()
        for length, number, name in marks:
            hashes, _, _, starts, owner, others = self.lengths[length]
            out.update(owner[starts[number] : starts[number + 1]].tolist() if name is None else others[int(hashes[number])][name])
        return {self.ids[i] for i in out if self.ids[i] is not None}


def _scanner(shared, last: bool):
    """Rows (id, text) or, from an earlier block, (id, text, hit_words, items) to the latter or, at the last, to SCHEMA."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: WindowSet = shared.value
        for batch in batches:
            n_words, hits, items, spans = [], [], [], []
            old_hits, old_items = (batch.column(k).to_pylist() for k in (2, 3)) if batch.num_columns > 2 else ([], [])
            for lo, hi, raw, offsets in blocks(batch.column(1)):
                words = Words(raw, offsets, ALNUM)
                n_words.append(words.counts())
                by_row: dict[int, tuple[set[int], set[str], set[tuple]]] = {}
                for row, places in enumerate(old_hits[lo:hi]):
                    if places:
                        by_row[row] = ({int(words.first[row]) + k for k in places}, set(old_items[lo + row]), set())
                seen = list(found.scan(words))
                rows = (np.searchsorted(words.first, np.array([k for k, _, _ in seen], np.int64), "right") - 1).tolist()
                for row, (k, length, mark) in zip(rows, seen):
                    marked, _, marks = by_row.setdefault(row, (set(), set(), set()))
                    marked.update(range(k, k + length))
                    marks.add(mark)
                for row in range(hi - lo):
                    if row not in by_row:
                        hits.append([])
                        items.append([])
                        spans.append([])
                        continue
                    marked, which, marks = by_row[row]
                    which |= found.items(marks)
                    place = np.array(sorted(marked))
                    hits.append((place - words.first[row]).tolist())
                    items.append(sorted(which))
                    edge = np.flatnonzero(np.diff(place) > 1)
                    runs = zip(place[np.concatenate([[0], edge + 1])], place[np.concatenate([edge, [len(place) - 1]])])
                    spans.append([{"start": int(words.start[a] - offsets[row]), "end": int(words.end[b] - offsets[row])} for a, b in runs])
            hit_words, items = pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hit_words, items], names=["id", "text", "hit_words", "items"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()),
                    hit_words,
                    items,
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["id", "n_words", "hit_words", "items", "spans"],
            )

    return scan


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``block_bytes`` of text, or one item; one block is on the driver at a time."""
    held: list[tuple] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        if held and size + len(row.t) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    yield held


def find_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document: id, n_words, hit_words (places), items (ids as strings) and spans (bytes of the text)."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    out, held = narrow, None
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:
            out = out.mapInArrow(_scanner(held, False), CARRIED.format(id=id_type))
        held = spark.sparkContext.broadcast(WindowSet(items, size))
    return out.mapInArrow(_scanner(held, True), SCHEMA.format(id=id_type)).withColumnRenamed("id", id_col)


def contaminated(n_hit, n_words):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, action: str = "documents", id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` without contaminated documents, or (``action="spans"``) with the hit spans cut out of all texts.

    The scan sees the whole row, so nothing is joined back: the row travels beside the text as it is, and with a
    benchmark of several blocks so do the places of its hit words. The last block's scan decides.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"action must be documents or spans, not {action!r}")
    spark = docs.sparkSession
    ship(spark)
    place = docs.columns.index(text_col)
    carried = StructType([*docs.schema.fields, StructField("__hit_words", ArrayType(IntegerType()))])
    out, held = docs, None
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:
            out = out.mapInArrow(_filter(held, place, None, len(docs.columns)), carried)
        held = spark.sparkContext.broadcast(WindowSet(items, size))
    return out.mapInArrow(_filter(held, place, action, len(docs.columns)), docs.schema)


def _filter(shared, place: int, action: str | None, width: int):
    """Marks the words that are hit, those marked by earlier blocks (column ``width``) too; without an action they go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: WindowSet = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            changed: dict[int, str] = {}
            places: list[np.ndarray] = []
            earlier = batch.column(width) if batch.num_columns > width else None
            for lo, hi, raw, offsets in blocks(batch.column(place)):
                words = Words(raw, offsets, ALNUM)
                hit = np.zeros(len(words.start) + 1, np.int32)
                for k, length, _ in found.scan(words):
                    hit[k] += 1
                    hit[k + length] -= 1
                marked = np.cumsum(hit[:-1]) > 0
                if earlier is not None:
                    known = earlier.slice(lo, hi - lo)
                    owner = np.repeat(words.first[:-1], known.value_lengths().to_numpy(zero_copy_only=False))
                    marked[owner + known.flatten().to_numpy(zero_copy_only=False)] = True
                # a window never reaches into the next row, so sums by row are right
                sums = np.concatenate([[0], np.cumsum(marked)])
                n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
                if action is None:
                    at = np.flatnonzero(marked)
                    places += np.split(at - np.repeat(words.first[:-1], n_hit), np.cumsum(n_hit)[:-1])
                    continue
                if action == "documents":
                    keep[lo : lo + len(n_hit)] = ~contaminated(n_hit, words.counts())
                    continue
                for row in np.flatnonzero(n_hit).tolist():
                    cut = np.ones(offsets[row + 1] - offsets[row], bool)
                    for k in np.flatnonzero(marked[words.first[row] : words.first[row + 1]]) + words.first[row]:
                        last = k + 1 < words.first[row + 1] and marked[k + 1]
                        cut[words.start[k] - offsets[row] : (words.start[k + 1] if last else words.end[k]) - offsets[row]] = False
                    changed[lo + row] = raw[offsets[row] : offsets[row + 1]][cut].tobytes().decode()
            own = pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema([batch.schema.field(k) for k in range(width)]))
            if action is None:
                marks = pa.array(places, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, marks], schema=own.schema.append(pa.field("__hit_words", marks.type)))
                continue
            if changed:
                texts = own.column(place).to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                own = own.set_column(place, own.schema.field(place), pa.array(texts, own.schema.field(place).type))
            yield own if keep.all() else own.filter(pa.array(keep))

    return run
