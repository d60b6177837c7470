"""Token counts: a count-only Viterbi over a unigram vocabulary, whose matches an Aho-Corasick automaton enumerates.

For each place of a word only the best score and its number of pieces are kept; no piece is stored and nothing is traced
back. The rules are the unigram tokenizer's own: pieces that end at a place are tried from the longest to the
shortest and replace the best only when they score higher; a place from which no piece of one character starts can go on by
an unknown character, at the vocabulary's lowest score less 10, tried last; neighbouring unknown characters fuse, and with
byte pieces in the vocabulary a fused unknown counts its UTF-8 bytes.

Words are runs between white space with the word mark before them; the automaton never looks across a word. A
word's count is remembered, at most ``REMEMBERED`` words in a worker, and a text's count is the sum. A word of any length takes
time in proportion to its length and the longest piece.

Defined results: null, empty and blank texts have no tokens; texts are counted whole; repeated rows get equal
counts; an empty table gives an empty result; only id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.shipping import ship

MARK = "▁"
#: White space as the tokenizer has it; Python's split() also ends words at the second kind.
_BLANK = re.compile("[ \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_BLANK = re.compile(r"[\x1c-\x1f]")
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores, by id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of words under a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{k:02X}>" in names for k in range(256))
        # a stop that no piece has behind a letter ends a segment there in any segmentation
        joined = {p[k + 1] for p in names for k in range(len(p) - 1) if p[k].isalpha()}
        self.stops = {c for c in ".,;:!?" if c in names and c not in joined}
        self.known: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        pieces = [0] * (n + 1)
        fused = [False] * (n + 1)  # an unknown character ends here
        single = [False] * (n + 1)  # so does a match of one character
        at = 0
        for end, (length, score) in self.automaton.iter(word):
            p = end + 1
            while at < end:  # places before p have all their pieces
                at += 1
                if not single[at]:
                    self._unknown(word, at, best, pieces, fused)
            if length == 1:
                single[p] = True
            new = best[p - length] + score
            if best[p] is None or new > best[p]:
                best[p] = new
                pieces[p] = pieces[p - length] + 1
        while at < n:
            at += 1
            if not single[at]:
                self._unknown(word, at, best, pieces, fused)
        return pieces[n]

    def _unknown(self, word: str, p: int, best: list, pieces: list[int], fused: list[bool]) -> None:
        """Goes from p - 1 to p by an unknown character; all that ends at p - 1 is settled."""
        new = best[p - 1] + self.unknown
        if best[p] is None or new > best[p]:
            best[p] = new
            fused[p] = True
            if self.bytes:
                pieces[p] = pieces[p - 1] + len(word[p - 1].encode("utf-8", "surrogatepass"))
            else:
                pieces[p] = pieces[p - 1] + (not fused[p - 1])

    def marked(self, run: str) -> int:
        """Pieces of a run between blanks: the mark stands before it, and marks inside start words of their own."""
        if MARK not in run:
            return self.word(MARK + run)
        return sum(self.word(MARK + part) for part in (run[1:] if run[0] == MARK else run).split(MARK))

    def _learn(self, run: str) -> int:
        got = self.old.get(run)
        if got is None and run[-1] in self.stops and run[-2:-1].isalpha():
            core = run[:-1]
            if core not in self.known:
                self.known[core] = self._learn(core)
            got = self.known[core] + 1
        return self.marked(run) if got is None else got

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        runs = _BLANK.split(text) if _NO_BLANK.search(text) else text.split()
        try:
            return sum(map(self.known.__getitem__, runs))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.old, self.known = self.known, {"": 0}
            known = self.known
            missing = set(runs).difference(known)
            for run in missing:
                known[run] = self._learn(run)
            out = sum(map(known.__getitem__, runs))
            for run in missing:  # long runs hardly come again
                if len(run) > 64:
                    del known[run]
                    known.pop(run[:-1], None)
            return out


_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id and n_tokens, by the vocabulary of a sentencepiece model file."""
    ship(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidepool.llm import tokencount

        if vocabulary_path not in tokencount._counters:
            tokencount._counters[vocabulary_path] = Counter(load_vocabulary(vocabulary_path))
        counter = tokencount._counters[vocabulary_path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = [counter.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return narrow.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
