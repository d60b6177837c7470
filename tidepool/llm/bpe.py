"""BPE encoding and decoding by tree concatenation.

A text is halved, and its halves, down to leaves of at most ``leaf`` bytes; a cut falls inside a word as soon as between words.
The leaves of a block of texts are encoded together, by the tokenizers library's threads. At each join a window of the last
words before and the first words behind the cut is encoded anew and grown until its outer words' tokens agree exactly, on
both sides, with those of the leaves; what the window has between them replaces what the leaves had. Blanks end a word for this kind of
tokenizer, so agreement on a word that is followed (before: preceded) by a blank is agreement on all beyond it. A window
that reaches the end of a leaf without agreement leaves the text to the library as a whole.

Inside a block each distinct word of the leaves goes to the library once, and is remembered beyond it: encoding every occurrence
anew costs about four times as much time. A word of more than ``leaf`` characters ("unsplit text") is a tree of its own:
leaves without blanks, and windows at each join that grow until ``AGREE`` outer tokens agree, in ids and places. Every
neighbouring pair of tokens then stems from a valid encoding, and a BPE encoding whose neighbouring pairs are all valid is
the encoding of the whole. Such words are never cut inside a special token, before a combining mark or inside a Hangul syllable, where
the tokenizer's normalisation looks across the cut, nor near an apostrophe, which its splitting pattern reads from the left.

Defined results: null is the empty text, with no tokens; texts are encoded whole; special tokens' strings in a text
are special tokens, as in the library; repeated rows give repeated results; an empty table gives an empty one;
only id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._words import ALNUM, NONSPACE, Words, blocks, group_sums
from tidepool.shipping import ship

LEAF = 2048
AGREE = 4
#: Words at each side of a cut with which a window begins.
REACH = 2
REMEMBERED = 150_000
BLOCK = 2 << 20
#: UTF-8 of the blanks beyond ASCII.
_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ASCII_ALNUM = ALNUM & (np.arange(256) < 128) | (np.arange(256) >= 65) & (np.arange(256) <= 90)
_BLANKS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_LETTER = (np.arange(256) >= 97) & (np.arange(256) <= 122)


class Tree:
    """Encodes long runs with a ``tokenizers.Tokenizer`` as a tree of leaves of at most ``leaf`` characters."""

    def __init__(self, tokenizer, leaf: int = LEAF, agree: int = AGREE):
        self.tokenizer, self.leaf, self.agree = tokenizer, max(leaf, 2), agree
        self.windows = 0  # encoded anew, for tests

    def whole(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(id, start, end) of each text's tokens, by the library."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [[(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)] for e in found]

    def cut(self, text: str, a: int, b: int) -> int | None:
        """A place near the middle of text[a:b] where the halves can part."""
        middle = (a + b) // 2
        for d in range((b - a) // 4):
            for p in (middle - d, middle + d):
                if a < p < b and self._apart(text, p):
                    return p
        return None

    @staticmethod
    def _apart(text: str, p: int) -> bool:
        c = text[p]
        if unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) <= 0x11FF or "<|" in text[max(0, p - 20) : p + 20]:
            return False
        near = text[max(0, p - 4) : p + 4]
        return not any(x in near for x in "'’")

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        spans, leaves = [(0, len(text))], []
        tree: dict[tuple[int, int], int | None] = {}
        while spans:
            a, b = spans.pop()
            p = self.cut(text, a, b) if b - a > self.leaf else None
            tree[a, b] = p
            if p is None:
                leaves.append((a, b))
            else:
                spans += [(a, p), (p, b)]
        found = {s: [(i, x + s[0], y + s[0]) for i, x, y in t] for s, t in zip(leaves, self.whole([text[a:b] for a, b in leaves]))}
        stack = [(0, len(text))]
        while stack:
            a, b = stack[-1]
            p = tree[a, b]
            if (a, b) in found:
                stack.pop()
            elif (a, p) in found and (p, b) in found:
                found[a, b] = self.join(text, found.pop((a, p)), found.pop((p, b)), a, b)
                stack.pop()
            else:
                stack += [(a, p), (p, b)]
        return found[0, len(text)]

    def join(self, text: str, left: list, right: list, start: int, end: int) -> list:
        """The encoding of text[start:end] from those of its two neighbouring pieces."""
        if not left or not right:
            return left + right
        reach = 2 * self.agree
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            while i and (left[i][1] != left[i - 1][2] or not self._apart(text, left[i][1])):  # inside a character
                i -= 1
            while j < len(right) and (right[j][1] != right[j - 1][2] or not self._apart(text, right[j][1])):
                j += 1
            a, b = (left[i][1] if i else start), (right[j - 1][2] if j < len(right) else end)
            self.windows += 1
            window = [(t, x + a, y + a) for t, x, y in self.whole([text[a:b]])[0]]
            whole_left, whole_right = i == 0, j == len(right)
            if whole_left and whole_right:
                return window
            head = 0 if whole_left else self._meet(left, i, window)
            tail = len(window) if whole_right else self._meet_end(right, j, window)
            if head is not None and tail is not None and head <= tail:
                front = window[:tail] if whole_left else left[: head_left(left, window[head])] + window[head:tail]
                return front if whole_right else front + right[head_left(right, window[tail - 1]) + 1 :]
            reach *= 2

    def _meet(self, left: list, i: int, window: list) -> int | None:
        """A token of the window from which ``agree`` tokens equal those of the left piece, past the window's own start."""
        own = {t: n for n, t in enumerate(left[i:], i)}
        for n in range(len(window) - self.agree):
            m = own.get(window[n])
            if m is not None and m + self.agree < len(left) and left[m : m + self.agree] == window[n : n + self.agree]:
                return n
        return None

    def _meet_end(self, right: list, j: int, window: list) -> int | None:
        """The end of ``agree`` window tokens, not its last, that equal tokens of the right piece."""
        own = {t: n for n, t in enumerate(right[:j])}
        for n in range(len(window) - 2, self.agree - 1, -1):
            m = own.get(window[n])
            if m is not None and m >= self.agree - 1 and right[m - self.agree + 1 : m + 1] == window[n - self.agree + 1 : n + 1]:
                return n + 1
        return None


def head_left(tokens: list, token: tuple) -> int:
    return tokens.index(token)


class Encoded:
    """The encodings of a block's texts: numbers of tokens, and all ids and all decoded tokens, each followed by a blank, as bytes."""

    def __init__(self, n: np.ndarray, ids: pa.Array, decoded: pa.Array, first: np.ndarray):
        self.n = n
        self._ids, self._decoded = self._joined(ids, first), self._joined(decoded, first)

    @staticmethod
    def _joined(pieces: pa.Array, first: np.ndarray) -> tuple[memoryview, list[int]]:
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
        data = pieces.buffers()[2]
        return memoryview(data) if data is not None else memoryview(b""), offsets[first].tolist()

    def ids(self, row: int) -> memoryview:
        data, at = self._ids
        return data[at[row] : max(at[row], at[row + 1] - 1)]

    def decoded(self, row: int) -> memoryview:
        data, at = self._decoded
        return data[at[row] : max(at[row], at[row + 1] - 1)]


class Coder:
    """Encodes blocks of texts; remembers words' ids and decoded tokens."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf = max(leaf, 8)
        self.tree = Tree(self.tokenizer, leaf)
        self.known: dict[bytes, tuple[int, str, str]] = {}
        self.old: dict[bytes, tuple[int, str, str]] = {}
        self.joins = self.grown = self.whole = 0  # for tests

    def library(self, texts: list[str], parallel: bool = True) -> list[tuple[int, str, str]]:
        """(number of tokens, ids, decoded tokens) of each text, with a blank behind each token."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel and len(texts) >= 64 else "false"
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._said(found)

    def _said(self, found: list[list[int]]) -> list[tuple[int, str, str]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        decoded = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        return [(len(ids), "".join([f"{i} " for i in ids]), f"{text} " if ids else "") for ids, text in zip(found, decoded)]

    def forget(self) -> None:
        """Lets go of the remembered words: an idle worker's memory is its neighbours' loss."""
        self.known, self.old = {}, {}

    def words(self, words: list[bytes]) -> list[tuple[int, str, str]]:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        missing = []
        for w in words:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    missing.append(w)
        long = {w: self._said([[t[0] for t in self.tree.encode(w.decode())]])[0] for w in missing if len(w) > self.leaf}
        if long:
            missing = [w for w in missing if w not in long]
        known.update(zip(missing, self.library([w.decode() for w in missing])))
        return [known[w] if w in known else long[w] for w in words] if long else list(map(known.__getitem__, words))

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where texts part: next to the middle of each piece over ``leaf`` bytes, at a blank or between ASCII letters or digits."""
        out = []
        lo, hi = offsets[:-1], offsets[1:]
        near = np.arange(min(64, self.leaf // 4))
        while True:
            long = hi - lo > self.leaf
            lo, hi = lo[long], hi[long]
            if not len(lo):
                break
            at = (lo + hi)[:, None] // 2 + near
            before, behind = raw[at - 1], raw[at]
            good = (_ASCII_ALNUM[before] & _ASCII_ALNUM[behind]) | ~NONSPACE[behind]
            found = good.any(axis=1)
            p = at[np.arange(len(lo)), good.argmax(axis=1)][found]
            lo, hi = lo[found], hi[found]
            out.append(p)
            lo, hi = np.concatenate([lo, p]), np.concatenate([p, hi])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Encodes the texts that ``offsets`` part ``raw`` into."""
        data = raw.tobytes()
        plain = b"<|" not in data  # or lower case could make a special token
        if any(x in data for x in _BLANKS) and _BLANK.search(data):
            data = _BLANK.sub(lambda m: b" " * len(m[0]), data)
            raw = np.frombuffer(data, np.uint8)
        cuts = self.cuts(raw, offsets)
        # a letter before a stop or comma always ends a word of the splitting pattern
        stops = np.flatnonzero((raw == 44) | (raw == 46))
        stops = stops[stops > 0]
        stops = stops[_LETTER[raw[stops - 1] | 32]]
        edges = np.sort(np.concatenate([offsets, cuts, stops]), kind="stable")
        words = Words(raw, edges[np.concatenate([[True], edges[1:] != edges[:-1]])], NONSPACE, plain)
        some, at, idx = np.unique(words.hash, return_index=True, return_inverse=True)
        data = words.bytes.tobytes()
        pieces = self.words([data[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())])
        first = np.searchsorted(words.start, offsets)
        if len(cuts):
            self.join(data, words, cuts, first, np.unique(np.concatenate([offsets, cuts])), idx, pieces)
        n = group_sums(np.array([p[0] for p in pieces], np.int64)[idx], first)
        ids, decoded = (pa.array([p[k] for p in pieces], pa.large_string()).take(pa.array(idx)) for k in (1, 2))
        return Encoded(n, ids, decoded, first)

    def join(self, data: bytes, words: Words, cuts: np.ndarray, first: np.ndarray, leaves: np.ndarray, idx: np.ndarray, pieces: list) -> None:
        """Replaces, around each cut, the words' encodings in ``idx`` by the window's. Texts without agreement go to the library as they are.

        A window goes from blank to blank and has to agree with the leaves in its first and last words between blanks, which no
        other cut touches, but for those at the text's own start and end.
        """
        start, end = words.start, words.end
        apart = np.concatenate([[True], end[:-1] < start[1:], [True]])  # a blank or a text's end stands before a word
        apart[first] = True
        leaf = np.searchsorted(start, leaves)
        number = np.searchsorted(leaves, cuts)
        behind = leaf[number]  # the first word behind each cut
        row = np.searchsorted(first, behind, "right") - 1
        todo = [
            (r, w, lo, hi, int(first[r]), int(first[r + 1]), REACH)
            for r, w, lo, hi in zip(row.tolist(), behind.tolist(), leaf[number - 1].tolist(), leaf[number + 1].tolist()) if lo < w < hi
        ]
        self.joins += len(todo)
        regions: dict[int, list[tuple[int, int, int, int, tuple[int, str, str]]]] = {}
        failed = set()
        while todo:
            spans = []
            for _, w, lo, hi, _, _, reach in todo:
                a, b = max(lo, w - reach), min(hi, w + reach)
                while a > lo and not apart[a]:
                    a -= 1
                while b < hi and not apart[b]:
                    b += 1
                spans.append((a, b))
            found = self.library([data[start[a] : end[b - 1]].decode() for a, b in spans])
            again = []
            for (r, w, lo, hi, head, tail, reach), (a, b), (n, ids, text) in zip(todo, spans, found):
                c, d = a, b
                if a > head:
                    c += 1
                    while c < w and not apart[c]:
                        c += 1
                if b < tail:
                    d -= 1
                    while d > w and not apart[d]:
                        d -= 1
                certain = (a == head or (a > lo and apart[a] and c < w)) and (b == tail or (b < hi and apart[b] and d > w))
                hn, hids, htext = _total([pieces[idx[i]] for i in range(a, c)])
                tn, tids, ttext = _total([pieces[idx[i]] for i in range(d, b)])
                if certain and hn + tn <= n and ids.startswith(hids) and f" {ids}".endswith(f" {tids}"):
                    middle = (n - hn - tn, ids[len(hids) : len(ids) - len(tids)], text[len(htext) : len(text) - len(ttext)])
                    regions.setdefault(r, []).append((a, c, d, b, middle))
                elif (a == lo or a == head) and (b == hi or b == tail):
                    failed.add(r)
                else:
                    self.grown += 1
                    again.append((r, w, lo, hi, head, tail, 2 * reach))
            todo = again
        empty = len(pieces)
        pieces.append((0, "", ""))
        for r, some in regions.items():
            some.sort(key=lambda x: x[1])
            if any(x[3] > y[1] or y[0] < x[2] for x, y in zip(some, some[1:])):
                failed.add(r)  # a window agreed with words that another one has replaced
            if r not in failed:
                for _, c, d, _, middle in some:
                    idx[c:d] = empty
                    idx[c] = len(pieces)
                    pieces.append(middle)
        self.whole += len(failed)
        for r, found in zip(failed, self.library([data[start[first[r]] : end[first[r + 1] - 1]].decode() for r in failed])):
            idx[first[r] : first[r + 1]] = empty
            idx[first[r]] = len(pieces)
            pieces.append(found)


def _total(pieces: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum(p[0] for p in pieces), "".join(p[1] for p in pieces), "".join(p[2] for p in pieces)


_coders: dict[tuple[str, int], Coder] = {}


def coder(path: str, leaf: int = LEAF) -> Coder:
    if (path, leaf) not in _coders:
        _coders[path, leaf] = Coder(path, leaf)
    return _coders[path, leaf]


def _integers(joined: memoryview) -> np.ndarray:
    return np.array(bytes(joined).split(), np.int32)


def _sha256(joined: memoryview) -> str:
    return hashlib.sha256(joined).hexdigest()


def _string(joined: memoryview) -> str:
    return bytes(joined).decode()


#: What a result's columns ids and decoded hold, and their types.
_OUTPUTS = {
    "texts": (_integers, pa.list_(pa.int32()), "array<int>", _string, pa.string()),
    "tokens": (_integers, pa.list_(pa.int32()), "array<int>", _sha256, pa.string()),
    "digests": (_sha256, pa.string(), "string", _sha256, pa.string()),
}


def _encoder(path: str, leaf: int, output: str):
    ids_of, ids_kind, _, text_of, text_kind = _OUTPUTS[output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, leaf)
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column(1), BLOCK):
                found = own.encode(raw, offsets)
                rows = range(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(found.n, pa.int64()),
                        pa.array([ids_of(found.ids(k)) for k in rows], ids_kind), pa.array([text_of(found.decoded(k)) for k in rows], text_kind),
                    ],
                    names=["id", "n_tokens", "ids", "decoded"],
                )
        own.forget()

    return run


def encode_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, ids (array) and decoded (text)."""
    return _run(df, tokenizer_path, id_col, text_col, leaf, "texts")


def encode_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, ids (array) and the SHA-256 of the decoded text."""
    return _run(df, tokenizer_path, id_col, text_col, leaf, "tokens").withColumnRenamed("decoded", "decoded_sha256")


def encode_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """The same with SHA-256 digests, made where the tokens are: of the ids joined by one space, and of the decoded text."""
    return _run(df, tokenizer_path, id_col, text_col, leaf, "digests").withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def _run(df: DataFrame, path: str, id_col: str, text_col: str, leaf: int, output: str) -> DataFrame:
    ship(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_encoder(path, leaf, output), f"id {kind}, n_tokens long, ids {_OUTPUTS[output][2]}, decoded string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``df``, all columns, with each text encoded and decoded; null stays null."""
    ship(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer_path, leaf).encode
        for batch in batches:
            own, kind = batch.column(place), batch.schema.field(place)
            for lo, hi, raw, offsets in blocks(own, BLOCK):
                found = encode(raw, offsets)
                texts = [_string(found.decoded(k)) if own[lo + k].is_valid else None for k in range(hi - lo)]
                yield batch.slice(lo, hi - lo).set_column(place, kind, pa.array(texts, kind.type))

    return df.mapInArrow(run, df.schema)
