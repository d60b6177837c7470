"""Line dedup: an exact set-similarity self-join of lines, of whose matches the later lines go.

A line's tokens are its distinct lower-cased words, ordered from rare to common: by the class of a token's exact count in
the corpus (quarters of log2), ties by hash. The ``LISTED`` most frequent tokens' classes are broadcast, a table of fixed
size; all others are rarer than these and stand before them.

1. One scan counts all words; counts travel packed by parts of the tokens' space.
2. A second scan makes prefix entries. Similar lines that differ share two tokens that are neighbours in both lines' orders,
   among the first ``prefix_length`` tokens of each: differing tokens cut the common ones into few runs, so that one
   of the first runs has two. So a key is a pair of neighbours, not a single token: a common word alone makes no
   candidates, and a line of n words has at most 0.4 n + 2 keys at 80 percent. Entries travel as packed columns, one row a batch
   and part of the key space, and a line set goes once for each batch.
3. In each part, entries are sorted by key and pair up under the length filter, the positional filter (what stands before
   and behind the shared key must suffice) and a filter on 16 small counts, which bound the difference of two sets from below. Keys
   of more than ``HOT`` sets, and parts beyond ``PART_MOST`` entries, make no pairs: their entries go on as they are, those of up to
   ``SIFTED`` sets only where a filter leaves them a partner.
4. A third scan writes every line with its set's fingerprint, and the sets of lines that have a candidate (a Bloom filter of
   bounded size tells; what it lets through in excess only costs space). Pairs are verified with Jaccard on the full sets.
5. The sets of a hot key come together in blocks of ``BLOCK``, a larger key's as pairs of blocks, and are compared by matrix
   products: only each set's number of links and its earliest link come out, so a group of near copies never becomes
   a table of its pairs. A pair with several hot keys counts at the smallest, and not among step 3's pairs.

A line is removed if an earlier line of the corpus, by (id, hash of the text, line), has a similarity of at least ``percent``.

Defined results: null texts and lines without a word have no rows and are never removed; equal lines (as sets) form one class
whose first line stays; a row is known by id and text, so rows that share an id, or have none, but not the text are rows
of their own, and repeated rows (equal id and text) keep their first lines each; a line of any length is one set; an empty
table gives an empty result; columns other than id and text are not read by :func:`line_matches`, and the other functions
carry them along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._shared import drop, release, written
from tidepool.llm._words import NONSPACE, U64, Words, blocks, group_sums, mix
from tidepool.shipping import ship

#: Most frequent tokens whose rarity class is broadcast.
LISTED = 1 << 17
#: Words that a task gathers before it counts them, and bits of a token that say by which part it is counted.
COUNTED = 1 << 22
COUNT_BITS = 10
HASH_BITS = 56
#: The Bloom filter has 2^23 to 2^27 bits, 16 for each fingerprint as far as that goes.
BLOOM_BITS, BLOOM_MOST = 23, 27
PART_ENTRIES = 1 << 19
#: Entries that a task gathers before it packs them.
PACKED = 1 << 18
PART_MOST = 1 << 23
HOT = 32
SIFTED = 1024
BLOCK = 1024
#: Keys of several blocks, with their sizes, are broadcast up to this number.
MOST_BROADCAST = 100_000
_NEWLINE = 10
_CHUNK = 1 << 18
#: Of a packed entry: the key within its part, the set's fingerprint, its size, the key's place and its tally.
_COLUMNS = ("key", "cls", "n", "pos", "tally")
_NARROW = ("<u4", "<i8", "<u2", "<u2", "<u8")
_WIDE = ("<u4", "<i8", "<i4", "<i4", "<u8")


def prefix_length(n, percent: int, run: int):
    """Tokens among which a line has a run of ``run`` neighbours with every other line of the similarity.

    With n - o own tokens missing from the other and H differing tokens in all, n - o + (H + 1) (run - 1) + 1 tokens hold one;
    o and H are linear in the other's size, so the most is at its least, percent n / 100, or its most, 100 n / percent.
    """
    least = run * (100 - percent) * n // 100 + run
    most = (run - 1) * (100 - percent) * n // percent + run
    return np.minimum(n, np.maximum(least, most))


def _line_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: first row, lines' rows, lines' numbers, word hashes, and lines' first words, with the end."""
    for lo, _, raw, offsets in blocks(column):
        words = Words(raw, offsets, NONSPACE)
        breaks = np.flatnonzero(raw == _NEWLINE)
        new = np.zeros(len(words.start) + 1, bool)
        new[words.first] = True
        new[np.searchsorted(words.start, breaks)] = True
        first = np.flatnonzero(new[:-1])
        row = np.searchsorted(words.first, first, "right") - 1
        line = np.searchsorted(breaks, words.start[first]) - np.searchsorted(breaks, offsets)[row]
        yield lo, row, line, words.hash, np.concatenate([first, [len(words.start)]])


def _order(values: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit values: by their first bits with the place behind them, as sorting values costs a fifth of sorting places."""
    mask = U64((1 << len(values).bit_length()) - 1)
    keys = values & ~mask | np.arange(len(values), dtype=U64)
    keys.sort()
    order = (keys & mask).view(np.int64)
    got = values[order]
    return np.argsort(values) if (got[1:] < got[:-1]).any() else order  # the first bits don't tell all apart


def _distinct_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit values in order, and the place of each value among them."""
    order = _order(values)
    got = values[order]
    new = np.ones(len(got), bool)
    new[1:] = got[1:] != got[:-1]
    where = np.empty(len(got), np.int64)
    where[order] = np.cumsum(new) - 1
    return got[new], where


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The items of ``data`` from each cut to the next, as bytes. One array has less than 2^31 of them."""
    at = (cuts * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _items(column: pa.Array, a: int, b: int, kind: str) -> np.ndarray:
    """The rows a to b of :func:`_binaries`, put together."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset + a : column.offset + b + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, tokens, counts): packed by the tokens' first bits, a token at most once for every ``COUNTED`` words."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.concatenate([start, [len(tokens)]])).astype(np.uint32)
        tokens = tokens[start]
        cuts = np.concatenate([np.searchsorted(tokens, np.arange(1 << COUNT_BITS, dtype=U64) << U64(64 - COUNT_BITS)), [len(tokens)]])
        part = np.flatnonzero(np.diff(cuts))
        cuts = np.concatenate([cuts[part], [len(tokens)]])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), _binaries(tokens, cuts), _binaries(counts, cuts)], names=["part", "tokens", "counts"])

    for batch in batches:
        for *_, hashes, _ in _line_words(batch.column(0)):
            held.append(hashes)
            size += len(hashes)
            if size > COUNTED:
                yield out()
                size = 0
    if size:
        yield out()


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts, sorted by part, to (tok, n) of the tokens that occur twice or more, and rows of no token for all others."""
    now, held, size, most = None, [], 0, COUNTED >> 1
    ready: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        tokens, counts = (np.concatenate(x) for x in zip(*held))
        order = _order(tokens << U64(COUNT_BITS))  # without the bits that all of a part share
        tokens = tokens[order]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        return tokens[start], np.add.reduceat(counts[order], start)

    def out() -> Iterator[pa.RecordBatch]:
        tokens, counts = (np.concatenate(x) for x in zip(*ready))
        many = counts > 1
        once = int(np.count_nonzero(~many))
        tokens, counts = tokens[many].view(np.int64), counts[many]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([once], pa.int64())], names=["tok", "n"])
        for k in range(0, len(tokens), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], names=["tok", "n"])

    for batch in batches:
        parts = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            if parts[a] != now:
                if held:
                    ready.append(merged())
                    if sum(len(t) for t, _ in ready) > 1 << 17:
                        yield from out()
                        ready = []
                now, held, size, most = parts[a], [], 0, COUNTED >> 1
            held.append((_items(batch.column(1), a, b, "<u8"), _items(batch.column(2), a, b, "<u4").astype(np.int64)))
            size += len(held[-1][0])
            if size > most:
                held = [merged()]
                size = len(held[0][0])
                most = max(COUNTED >> 1, 2 * size)
    if held:
        ready.append(merged())
    if ready:
        yield from out()


def _rarity(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``LISTED`` most frequent tokens in order, their classes, and the number of words. Only these tokens reach the driver."""
    packed = texts.mapInArrow(_counter, "part int, tokens binary, counts binary").repartition("part").sortWithinPartitions("part")
    counts = packed.mapInArrow(_merger, "tok long, n long")
    counts = written(counts.withColumn("class", F.when(F.col("tok").isNull(), 0).otherwise(F.floor(4 * F.log2("n"))).cast("int")))
    classes = counts.groupBy("class").agg(F.count("*").alias("tokens"), F.sum("n").alias("words")).orderBy(F.desc("class")).collect()
    least, listed = 1 << 30, 0  # the lowest class that fits as a whole
    for row in classes:
        listed += row["tokens"]
        if listed > LISTED or row["class"] == 0:
            break
        least = row["class"]
    found = counts.where(F.col("class") >= least).select("tok", "class").toArrow()
    drop(counts)
    tokens, kinds = found.column(0).to_numpy().view(U64), found.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], (kinds[order] + 1).astype(U64), sum(r["words"] for r in classes)


def _tokens(hashes: np.ndarray, at: np.ndarray, listed: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line from rare to common, and the lines' first ones, with the end."""
    some, where = _distinct_values(hashes)
    rarity = np.zeros(len(some), U64)
    if len(listed):
        place = np.minimum(np.searchsorted(listed, some), len(listed) - 1)
        rarity = np.where(listed[place] == some, kinds[place], U64(0))
    ranked, rank = _distinct_values(rarity << U64(HASH_BITS) | mix(some) >> U64(64 - HASH_BITS))
    bits = len(ranked).bit_length()
    kind = np.uint32 if (len(at) - 1) << bits <= 1 << 32 else U64
    keys = np.repeat(np.arange(len(at) - 1).astype(kind) << kind(bits), np.diff(at)) | rank.astype(kind)[where]
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    counts = np.concatenate([[0], np.cumsum(new)])
    return ranked[keys[new] & kind((1 << bits) - 1)], counts[at]


def _tally(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each line's numbers of tokens in 16 classes, modulo 16, in the 64 bits of a number."""
    line = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    counts = np.bincount(line * 16 + (mix(tokens ^ U64(0x2545F4914F6CDD1D)) >> U64(60)).astype(np.int64), minlength=16 * (len(ends) - 1))
    return np.bitwise_or.reduce((counts.astype(U64) & U64(15)).reshape(-1, 16) << (U64(4) * np.arange(16, dtype=U64)), axis=1)


_EIGHTS, _ONES, _LOW, _SUM = (U64(x) for x in (0x8888888888888888, 0x1111111111111111, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101))


def _least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of the distances of two tallies' classes, each round the circle of 16: sets differ in at least as many tokens."""
    d = ((x | _EIGHTS) - (y & ~_EIGHTS)) ^ ((x ^ ~y) & _EIGHTS)  # by class, modulo 16
    over = ((d & _EIGHTS) >> U64(3)) * U64(15)
    d = (d ^ over) + (over & _ONES)
    return ((((d & _LOW) + ((d >> U64(4)) & _LOW)) * _SUM) >> U64(56)).astype(np.int64)


class _Seen:
    """Tells which fingerprints come for the first time; one whose place another one took is told again."""

    def __init__(self, bits: int = 19):
        self.known = np.zeros(1 << bits, np.int64)
        self.shift = U64(64 - bits)

    def fresh(self, classes: np.ndarray) -> np.ndarray:
        some, first = np.unique(classes.view(np.int64), return_index=True)
        place = some.view(U64) >> self.shift
        new = (self.known[place] != some) | (some == 0)
        self.known[place] = some
        out = np.zeros(len(classes), bool)
        out[first[new]] = True
        return out


def _entries(tokens: np.ndarray, ends: np.ndarray, percent: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines: hash, line and place of each run of neighbouring tokens in a prefix. Too small lines have no match but equal ones."""
    n = np.diff(ends)
    starts = np.where(n >= smallest(percent), prefix_length(n, percent, run) - run + 1, 0)
    line = np.repeat(np.arange(len(n)), starts)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = ends[line] + pos
    key = tokens[at]
    for k in range(1, run):
        key = mix(key) * U64(0x9E3779B97F4A7C15) + tokens[at + k]
    return mix(key), line, pos


def smallest(percent: int) -> int:
    """The least tokens of a line that another set can match: the n for which n / (n + 1) reaches the similarity."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _packer(percent: int, run: int, parts: int, shared):
    """(text) to (part, wide, key, cls, n, pos, tally): the entries of lines, each column packed, by part of the key space."""
    small = np.uint16 if parts <= 1 << 16 else np.int32  # numpy sorts 16 bits by radix

    def flush(held: list[tuple]) -> pa.RecordBatch:
        key, line, pos = (np.concatenate([h[k] for h in held]) for k in range(3))
        lines = np.cumsum([0] + [len(h[3]) for h in held])
        line += np.repeat(lines[:-1], [len(h[1]) for h in held])
        cls, n, tally = (np.concatenate([h[k] for h in held]) for k in range(3, 6))
        part = ((key >> U64(32)) * U64(parts) >> U64(32)).astype(small)
        order = np.argsort(part, kind="stable")
        part, line = part[order], line[order]
        wide = bool(n.max() >= 1 << 16)
        size = np.int32 if wide else np.uint16
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        columns = (key.astype(np.uint32)[order], cls[line], n.astype(size)[line], pos.astype(size)[order], tally[line])
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, wide)), *(_binaries(c, cuts) for c in columns)], names=["part", "wide", *_COLUMNS]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, kinds, _ = shared.value
        seen = _Seen()
        held, size = [], 0
        for batch in batches:
            for _, _, _, hashes, at in _line_words(batch.column(0)):
                tokens, ends = _tokens(hashes, at, listed, kinds)
                classes = group_sums(mix(tokens), ends).view(np.int64)
                n = np.diff(ends)
                keep = seen.fresh(classes) & (n >= smallest(percent))
                tokens, classes, n = tokens[np.repeat(keep, n)], classes[keep], n[keep]
                ends = np.concatenate([[0], np.cumsum(n)])
                key, line, pos = _entries(tokens, ends, percent, run)
                if not len(key):
                    continue
                held.append((key, line, pos, classes, n, _tally(tokens, ends)))
                size += len(key)
                if size > PACKED:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return pack


def _pairer(percent: int):
    """Packed entries, sorted by part, to candidate pairs (a, b) of fingerprints, each once a part, and (a, key) for sets whose key
    or part is hot. One part, ``PART_MOST`` entries at most, is held."""

    def batch(a, b=None, key=None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 1 << 17):
            columns = [pa.nulls(len(a[k : k + (1 << 17)]), pa.int64()) if x is None else pa.array(x[k : k + (1 << 17)], pa.int64()) for x in (a, b, key)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

    def left(cls: np.ndarray, key: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        yield from batch(cls, None, key.astype(np.int64) | part << 32)

    def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return start, np.diff(np.concatenate([start, [len(key)]]))

    def pairs(columns: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        key, cls, n, pos, tally = columns
        order = _order(key.astype(U64) << U64(32))
        start, sizes = groups(key[order])
        order = order[np.repeat(sizes > 1, sizes)]
        if not len(order):
            return
        key, cls = key[order], cls[order]
        start, sizes = groups(key)
        shared = np.repeat(np.minimum.reduceat(cls, start) != np.maximum.reduceat(cls, start), sizes)
        order, key, cls = order[shared], key[shared], cls[shared]
        if not len(order):
            return
        n = n[order].astype(np.int64)
        place = _by_size(key, n, cls)
        order, key, cls, n = order[place], key[place], cls[place], n[place]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        order, key, cls, n = order[new], key[new], cls[new], n[new]
        start, sizes = groups(key)
        whole = np.repeat(sizes > SIFTED, sizes)
        if whole.any():
            yield from left(cls[whole], key[whole], part)
            order, key, cls, n = order[~whole], key[~whole], cls[~whole], n[~whole]
            if not len(order):
                return
            start, sizes = groups(key)
        hot = np.repeat(sizes > HOT, sizes)
        alive = np.zeros(len(key), bool)  # entries of hot keys that have a candidate
        pos, tally = pos[order].astype(np.int64), tally[order]
        group = np.repeat(np.arange(len(start)), sizes) << 32
        end = np.searchsorted(group + n, group + n * 100 // percent, "right")  # the length filter, by search
        partners = end - np.arange(len(key)) - 1
        sums = np.concatenate([[0], np.cumsum(partners)])
        at = 0
        out: list[np.ndarray] = []
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + _CHUNK, "right")) - 1)
            x = np.repeat(np.arange(at, to), partners[at:to])
            y = x + 1 + np.arange(len(x)) - (sums[x] - sums[at])
            both = n[x] + n[y]
            good = (100 + percent) * (np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])) >= percent * both
            x, y, both = x[good], y[good], both[good]
            good = (100 + percent) * _least_difference(tally[x], tally[y]) <= (100 - percent) * both
            x, y = x[good], y[good]
            many = hot[x]
            alive[x[many]] = True
            alive[y[many]] = True
            a, b = cls[x[~many]], cls[y[~many]]
            out.append(_distinct(np.stack([np.minimum(a, b), np.maximum(a, b)])))
            if len(out) > 1 and sum(o.shape[1] for o in out) > 8 * _CHUNK:
                out = [_distinct(np.concatenate(out, axis=1))]
                if out[0].shape[1] > 4 * _CHUNK:
                    yield from batch(*out.pop())
            at = to
        if alive.any():
            yield from left(cls[alive], key[alive], part)
        if out:
            yield from batch(*_distinct(np.concatenate(out, axis=1)))

    def joined(held: list[tuple]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for some in batches:
            parts, wide = some.column(0).to_numpy(), some.column(1).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (wide[1:] != wide[:-1])) + 1).tolist(), len(parts)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                part = int(parts[a])
                if part != now:
                    if held:
                        yield from pairs(joined(held), now)
                    now, held, size = part, [], 0
                held.append(tuple(_items(some.column(k), a, b, kind) for k, kind in enumerate(_WIDE if wide[a] else _NARROW, 2)))
                size += len(held[-1][0])
                if size > PART_MOST or size < 0:
                    key, cls = joined(held)[:2]
                    yield from left(cls, key, now)
                    held, size = [], -(1 << 62)  # all of this part's
        if held:
            yield from pairs(joined(held), now)

    return run


def _by_size(key: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The order by (key, n, cls) of entries that are sorted by key."""
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(U64)
    if group[-1] < 1 << 23 and n.max() < 1 << 17:
        code = group << U64(41) | n.astype(U64) << U64(24) | (cls ^ np.int64(-(1 << 63))).view(U64) >> U64(40)
        order = np.argsort(code)
        code, own = code[order], cls[order]
        if not ((code[1:] == code[:-1]) & (own[1:] != own[:-1])).any():  # else the 24 bits don't tell all apart
            return order
    return np.lexsort((cls, n, group))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort(pairs)
    pairs = pairs[:, order]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, new]


def _candidates(texts: DataFrame, shared, words: int, percent: int, run: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of fingerprints that pass the filters, and the hot keys (cls, key)."""
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(least, words // 2 // PART_ENTRIES), 1 << 30)
    entries = texts.mapInArrow(_packer(percent, run, parts, shared), "part int, wide boolean, " + ", ".join(f"{c} binary" for c in _COLUMNS))
    raw = written(entries.repartition("part").sortWithinPartitions("part").mapInArrow(_pairer(percent), "a long, b long, key long"))
    release(texts.sparkSession)
    pairs = written(raw.where("b IS NOT NULL").select("a", "b").distinct())
    hot = written(raw.where("b IS NULL").select(F.col("a").alias("cls"), "key").distinct())
    drop(raw)
    return pairs, hot


def _bloom(classes: DataFrame) -> np.ndarray:
    """Bits, two of each fingerprint set: at most 2^21 rows reach the driver."""
    bits = min(max((16 * classes.count() - 1).bit_length(), BLOOM_BITS), BLOOM_MOST)
    places = F.array(F.shiftrightunsigned("cls", 64 - bits), F.shiftrightunsigned(F.shiftleft("cls", 32), 64 - bits))
    words = classes.select(F.explode(places).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(U64)


def _may_hold(bloom: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set."""
    shift = U64(64 - (len(bloom).bit_length() + 5))
    one, two = classes >> shift, classes << U64(32) >> shift
    return (bloom[one >> U64(6)] >> (one & U64(63)) & bloom[two >> U64(6)] >> (two & U64(63)) & U64(1)).astype(bool)


def _liner(shared):
    """(id, th, text) to all lines; ``may``: the set may have a candidate, and comes with its first line of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, kinds, bloom = shared.value
        seen = _Seen()
        for batch in batches:
            for lo, rows, lines, hashes, at in _line_words(batch.column(2)):
                tokens, ends = _tokens(hashes, at, listed, kinds)
                classes = group_sums(mix(tokens), ends)
                may = _may_hold(bloom, classes)
                told = np.flatnonzero(may)
                told = told[seen.fresh(classes[told])]
                n = np.diff(ends)
                with_set = np.zeros(len(n), bool)
                with_set[told] = True
                sizes = np.concatenate([[0], np.cumsum(np.where(with_set, n, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows + lo)), batch.column(1).take(pa.array(rows + lo)), pa.array(lines, pa.int32()), pa.array(n, pa.int32()),
                        pa.array(classes.view(np.int64)), pa.array(may),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(tokens[np.repeat(with_set, n)].view(np.int64)), mask=pa.array(~with_set)),
                    ],
                    names=["id", "th", "line_no", "n", "cls", "may", "tokens"],
                )

    return run


def _common(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, n) numbers of common values of n sets, given as (row, value) pairs: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((n, n), np.float32)
    some, column, times = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # what only one set has is in no intersection
    keep = times[column] > 1
    rows, column = rows[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (k, k + 4096))
        m = np.zeros((n, min(4096, int(column[-1]) + 1 - k)), np.float32)
        m[rows[a:b], column[a:b] - k] = 1
        out += m @ m.T
    return out


def _comparer(percent: int):
    """Rows (unit: key, i, j; block, cls, tokens, keys), sorted by unit and place, to (cls, n_links, match): a set's links inside its
    units and the earliest of them. A unit is two blocks, or one with itself."""

    def links(unit: tuple, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        block, cls, tokens, keys = columns
        n = len(cls)
        if n < 2:
            return
        block, cls = block.to_numpy(), cls.to_numpy()
        sizes = tokens.value_lengths().to_numpy()
        common = _common(np.repeat(np.arange(n), sizes), tokens.flatten().to_numpy(), n)
        good = (100 + percent) * common >= percent * (sizes[:, None] + sizes[None, :]).astype(np.float32)
        np.fill_diagonal(good, False)
        if unit[1] != unit[2]:
            good &= block[:, None] != block[None, :]
        row, key = np.repeat(np.arange(n), keys.value_lengths().to_numpy()), keys.flatten().to_numpy()
        less = key < unit[0]
        if less.any():
            good &= _common(row[less], key[less], n) == 0  # counted there
        found = np.flatnonzero(good.any(axis=1))
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[found]), pa.array(good[found].sum(axis=1).astype(np.int64)), pa.array(cls[good[found].argmax(axis=1)])], names=["cls", "n_links", "match"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            units = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((units[1:] != units[:-1]).any(axis=1)) + 1).tolist(), len(units)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                unit = tuple(units[a].tolist())
                if unit != now:
                    if held:
                        yield from links(now, [pa.concat_arrays(x) for x in zip(*held)])
                    now, held = unit, []
                held.append([batch.column(k).slice(a, b - a) for k in range(3, 7)])
        if held:
            yield from links(now, [pa.concat_arrays(x) for x in zip(*held)])

    return run


def _hot_links(hot: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(cls, n_links, match) of links between sets of a hot key; ``full`` has cls, tokens, keys and first of these sets."""
    sizes = hot.groupBy("key").count().where(F.col("count") > BLOCK)
    big = written(sizes.select(F.col("key").alias("k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    big = F.broadcast(big) if big.count() <= MOST_BROADCAST else big
    entries = full.select("cls", "tokens", "keys", "first", F.explode("keys").alias("key")).join(big, F.col("key") == F.col("k"), "left")
    blocks_ = F.coalesce("blocks", F.lit(1))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("cls"), blocks_).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks_ - 1)))
    entries = entries.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "tokens", "keys", "first")
    entries = entries.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "first").drop("first")
    return entries.mapInArrow(_comparer(percent), "cls long, n_links long, match long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): a row is known by its id and its text's hash."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _matched(docs: DataFrame, id_col: str, text_col: str, percent: int, run: int) -> DataFrame:
    """Each line: id, th, line_no, n, first and match (places of its class's first line and of the earliest linked class's), n_links."""
    spark = docs.sparkSession
    ship(spark)
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    run = run if percent >= 75 else 1  # below, two neighbours are not certain
    rows = _keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    listed, kinds, words = _rarity(rows.select("text"))
    shared = spark.sparkContext.broadcast((listed, kinds, None))
    pairs, hot = _candidates(rows.select("text"), shared, words, percent, run)
    release(spark)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(hot.select("cls"))
    with_bloom = spark.sparkContext.broadcast((listed, kinds, _bloom(involved)))
    lines = written(rows.mapInArrow(_liner(with_bloom), f"id {kind}, th long, line_no int, n int, cls long, may boolean, tokens array<long>"))
    here = F.struct("id", "th", "line_no")
    sets = lines.where("may").groupBy("cls").agg(F.min(here).alias("first"), F.first("tokens", ignorenulls=True).alias("tokens"))
    sets = written(sets.withColumn("n", F.size("tokens")))
    keys = written(hot.groupBy("cls").agg(F.collect_list("key").alias("keys")))
    full = sets.join(keys, "cls")
    found = [_hot_links(hot, full, percent)]
    sides = sets.join(keys, "cls", "left").withColumn("keys", F.coalesce("keys", F.expr("CAST(array() AS array<bigint>)")))
    x, y = (sides.select(F.col("cls").alias(p), F.col("tokens").alias(f"t{p}"), F.col("keys").alias(f"k{p}")) for p in "ab")
    good = f"{100 + percent} * size(array_intersect(ta, tb)) >= {percent} * (size(ta) + size(tb)) AND NOT arrays_overlap(ka, kb)"
    links = written(pairs.join(x, "a").join(y, "b").where(good).select("a", "b"))
    one = F.lit(1).cast("long").alias("n_links")
    found += [links.select(F.col(p).alias("cls"), one, F.col(q).alias("match")) for p, q in (("a", "b"), ("b", "a"))]
    found = written(found[0].unionByName(found[1]).unionByName(found[2]))
    drop(pairs, hot, keys, links)
    release(spark)
    linked = found.join(sets.select(F.col("cls").alias("match"), "first"), "match").groupBy("cls").agg(F.sum("n_links").alias("n_links"), F.min("first").alias("match"))
    linked = written(linked.join(sets.select("cls", "n"), "cls"))
    drop(found, sets)
    release(spark)
    known = lines.groupBy("cls", "n").agg(F.min(here).alias("first")).join(linked, ["cls", "n"], "left")
    out = lines.select("id", "th", "line_no", "n", "cls").join(known.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), ["cls", "n"])
    earlier = F.coalesce(F.col("match") < F.col("first"), F.lit(False))
    return out.select("id", "th", "line_no", "n", "first", "match", "n_links", (~here.eqNullSafe(F.col("first")) | earlier).alias("removed"), F.when(earlier, F.col("match")).otherwise(F.col("first")).alias("source"))


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, run: int = 2) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), n_tokens, its class's first line (class_id, class_line),
    n_links (other classes at the similarity), the earliest linked class's first line, and removed."""
    return _matched(docs, id_col, text_col, percent, run).select(
        F.col("id").alias(id_col), "line_no", F.col("n").cast("long").alias("n_tokens"), F.col("first.id").alias("class_id"), F.col("first.line_no").alias("class_line"),
        "n_links", F.col("match.id").alias("match_id"), F.col("match.line_no").alias("match_line"), "removed",
    )


def _whole_copies(lines: DataFrame, copies: int) -> DataFrame:
    """(id, th, s_id, s_th): rows that are a copy, as a whole, of one earlier row.

    Measured in tokens of lines: what matches the source, against the union of what either has beside the lines that match a
    third row and the row's own repeats. A row has one source at most, that of which most lines match.
    """
    own = F.col("source.id").eqNullSafe(F.col("id")) & (F.col("source.th") == F.col("th"))
    sizes = lines.groupBy("id", "th").agg(F.sum(F.when(~F.col("removed"), F.col("n")).otherwise(0)).alias("kept"))
    shares = lines.where(F.col("removed") & ~own).groupBy("id", "th", F.col("source.id").alias("s_id"), F.col("source.th").alias("s_th")).agg(F.sum("n").alias("same"))
    best = shares.groupBy("id", "th").agg(F.max(F.struct("same", F.struct("s_id", "s_th").alias("s"))).alias("best")).select("id", "th", "best.same", "best.s.*")
    best = best.join(sizes.select(F.col("id").alias("i"), F.col("th").alias("t"), "kept"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).drop("i", "t")
    source = sizes.select(F.col("id").alias("i"), F.col("th").alias("t"), F.col("kept").alias("s_kept"))
    best = best.join(source, F.col("s_id").eqNullSafe(F.col("i")) & (F.col("s_th") == F.col("t")))
    # the source's own lines that match are kept there; the union counts them once
    return best.where(F.expr(f"100 * same >= {copies} * (kept + greatest(s_kept, same))")).select("id", "th", "s_id", "s_th")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, run: int = 2, leave_copies: int | None = None, drop_empty: bool = False
) -> DataFrame:
    """``docs``, all rows and columns, without the lines that :func:`line_matches` removes.

    A text whose lines all go is empty, or its row goes with ``drop_empty``. ``n_chars``, if there is one, is counted anew where a
    line went. With ``leave_copies``, a row of which that many percent are one earlier row's keeps these lines: it is a
    copy as a whole, and which of the two stays is for a near-dedup to say, on texts that are not in shreds.
    """
    lines = _matched(docs, id_col, text_col, percent, run)
    if leave_copies is not None:
        lines = written(lines.select("id", "th", "line_no", "n", "removed", "source"))
        whole = _whole_copies(lines, leave_copies).select(F.col("id").alias("i"), F.col("th").alias("t"), "s_id", "s_th", F.lit(True).alias("whole"))
        gone = lines.where("removed").join(whole, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
        gone = gone.where(F.col("whole").isNull() | ~(F.col("source.id").eqNullSafe(F.col("s_id")) & (F.col("source.th") == F.col("s_th"))))
    else:
        gone = lines.where("removed")
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("line_no").alias("__gone"))
    names = [f"__c{k}" for k in range(len(docs.columns))]
    out = docs.toDF(*names)
    place = docs.columns.index(text_col)
    text = F.col(names[place])
    out = out.join(gone, F.col(names[docs.columns.index(id_col)]).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn("__text", F.when(F.col("__gone").isNotNull(), kept).otherwise(text))
    if drop_empty:
        out = out.where(F.col("__gone").isNull() | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for k, c in enumerate(docs.columns):
        if k == place:
            columns.append(F.col("__text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("__gone").isNotNull(), F.length("__text")).otherwise(F.col(names[k])).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(names[k]).alias(c))
    return out.select(*columns)
