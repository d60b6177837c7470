"""Language ID by compression: per-language zstandard raw-content dictionaries, the smallest encoding wins.

Fitting takes a bounded sample of labelled rows, ``SAMPLE_ROWS`` a language, those with the smallest hash of their id:
per-language counts give the hash below which about twice as many rows lie, so one task gathers a bounded number. Their texts,
up to ``DICTIONARY_BYTES`` a language, are the dictionary's content, and no more reaches the driver; a language with fewer bytes of
text has a smaller one and takes nothing from the others. Every language of the labelled rows is learned.

Every whole text is encoded in pieces of ``PIECE`` bytes with each dictionary, so a long text does not learn itself,
and sizes are summed. The prediction is the smallest sum, ties by language name; the score is the margin to the second,
as a part of it, scaled by ``FULL_MARGIN`` to 0..1, and a score under ``REJECT`` sets ``rejected``.

Defined results: null texts and texts without a letter are ``und`` with score 0; without a learned language all are ``und``;
repeated rows get equal predictions; an empty table gives an empty result; columns other than those named are not
read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm._shared import written
from tidepool.shipping import ship

SAMPLE_ROWS = 200
DICTIONARY_BYTES = 64 << 10
PIECE = 4096
MOST_BROADCAST = 10_000
LEVEL = 5
REJECT = 0.02
FULL_MARGIN = 0.25
_LETTER = regex.compile(r"\p{L}")
_RANGE = 1 << 32


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary contents by language, learned from rows with a text, not an empty one, and a language."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text <> '' AND lang IS NOT NULL")
    limits = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), 2 * sample_rows / F.count("*")).alias("share")))
    limits = F.broadcast(limits) if limits.count() <= MOST_BROADCAST else limits  # one number a language
    place = F.pmod(F.xxhash64("id", "text"), F.lit(_RANGE))
    # no text needs more bytes than one dictionary has
    picked = rows.select("lang", place.alias("place"), F.substring("text", 1, dictionary_bytes).alias("text")).join(limits, "lang").where(F.col("place") < F.col("share") * _RANGE)
    texts = F.slice(F.array_sort(F.collect_list(F.struct("place", "text"))), 1, sample_rows)
    content = F.substring(F.array_join(F.transform(texts, lambda t: t["text"]), "\n"), 1, dictionary_bytes)
    ranked = picked.groupBy("lang").agg(content.alias("content")).collect()
    return {r["lang"]: r["content"].encode()[:dictionary_bytes] for r in sorted(ranked, key=lambda r: r["lang"])}


class Classifier:
    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, piece: int = PIECE):
        self.names = sorted(contents)
        self.piece = piece
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0
        raw = text.encode()
        pieces = [raw[k : k + self.piece] for k in range(0, len(raw), self.piece)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], self.names[k]))
        if len(order) == 1:
            return self.names[order[0]], 1.0
        margin = 1 - sizes[order[0]] / sizes[order[1]]
        return self.names[order[0]], min(1.0, margin / FULL_MARGIN)


def predict(df: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, held_out, lang_pred, score (0 to 1) and rejected."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(contents)
    narrow = df.select(F.col(id_col).alias("id"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [classify(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    names=["id", "held_out", "lang_pred", "score"],
                )

    out = narrow.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", (F.col("score") < REJECT).alias("rejected"))
