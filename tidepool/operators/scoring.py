"""Passage scorers: a protocol, a distributed runner with its checks, and two scorers that need no model file."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from time import perf_counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import query_terms, terms
from tidepool.operators.models import Profile, graph_problems
from tidepool.shipping import ship


class Scorer(Protocol):
    def score_batch(self, query: str, passages: Sequence[str]) -> Sequence[float]: ...


class ScoringError(RuntimeError):
    """A scorer failed; a search never falls back to lexical results."""


def score(chunks: DataFrame, query: str, scorer: Scorer, batch_size: int = 1) -> DataFrame:
    """(chunk_index, relevance_logit float) of chunks with a passage, in batches of consecutive rows."""
    if batch_size < 1:
        raise ValueError("the batch size must be at least 1")
    ship(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            passages = pdf["passage"].tolist()
            for k in range(0, len(passages), batch_size):
                part = passages[k : k + batch_size]
                found = np.asarray(scorer.score_batch(query, part), np.float32)
                if found.shape != (len(part),):
                    raise ScoringError(f"the scorer gave {found.shape} scores for {len(part)} passages")
                if not np.isfinite(found).all():
                    raise ScoringError("the scorer gave a score that is not finite")
                out.append(found)
            yield pd.DataFrame({"chunk_index": pdf["chunk_index"], "relevance_logit": np.concatenate(out) if out else np.zeros(0, np.float32)})

    return chunks.select("chunk_index", "passage").mapInPandas(run, "chunk_index long, relevance_logit float")


def coverage_score(query: str, text: Column, normalize: bool = True) -> Column:
    """A deterministic scorer on Catalyst functions: distinct query terms present, less a thousandth of the length."""
    found = F.size(F.array_intersect(terms(text, normalize), F.array(*[F.lit(t) for t in query_terms(query)])))
    return (found - F.char_length(text) / 1000.0).cast("float")


class CoverageScorer:
    """The same in Python, for the protocol."""

    def score_batch(self, query: str, passages: Sequence[str]) -> list[float]:
        asked = set(query_terms(query))
        return [len(asked & set(query_terms(p))) - len(p) / 1000.0 for p in passages]


class OnnxScorer:
    """A local cross-encoder: ``model.onnx`` and ``tokenizer.json`` of a folder, loaded once in each worker."""

    def __init__(self, folder: str, query_limit: int = 64, pair_limit: int = 256, threads: int = 1, profile: Profile | None = None):
        self.profile = profile
        self.folder, self.query_limit, self.pair_limit, self.threads = folder, query_limit, pair_limit, threads
        self.seconds = {"tokenization": 0.0, "inference": 0.0}  # of this process
        self._session = self._tokenizer = self._prepared = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None, "_tokenizer": None, "_prepared": None}

    def _load(self):
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            self._session = onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), options)
            self._tokenizer = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
            if self.profile is not None:
                wrong = graph_problems(self.profile, [i.name for i in self._session.get_inputs()], [o.name for o in self._session.get_outputs()])
                if wrong:
                    raise ScoringError("the model's graph is not its profile's: " + ", ".join(wrong))

    def pair_length(self, query: str, passage: str) -> int:
        """Tokens of the pair; the query is encoded once for all its passages."""
        self._load()
        if self._prepared is None or self._prepared[0] != query:
            own = len(self._tokenizer.encode(query, add_special_tokens=False).ids)
            if own > self.query_limit:
                raise ScoringError(f"the query has more than {self.query_limit} tokens")
            self._prepared = query, own + self._tokenizer.num_special_tokens_to_add(True)
        return self._prepared[1] + len(self._tokenizer.encode(passage, add_special_tokens=False).ids)

    def score_batch(self, query: str, passages: Sequence[str]) -> np.ndarray:
        self._load()
        began = perf_counter()
        if len(self._tokenizer.encode(query).ids) > self.query_limit:
            raise ScoringError(f"the query has more than {self.query_limit} tokens")
        found = self._tokenizer.encode_batch([(query, p) for p in passages])
        width = max(len(e.ids) for e in found)
        if width > self.pair_limit:
            raise ScoringError(f"a pair has {width} tokens; the limit is {self.pair_limit}")
        pad = self._tokenizer.token_to_id("[PAD]") or 0
        ids = np.array([e.ids + [pad] * (width - len(e.ids)) for e in found], np.int64)
        mask = np.array([[1] * len(e.ids) + [0] * (width - len(e.ids)) for e in found], np.int64)
        kinds = np.array([e.type_ids + [0] * (width - len(e.ids)) for e in found], np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}
        names = {i.name for i in self._session.get_inputs()}
        encoded = perf_counter()
        out = self._session.run(None, {k: v for k, v in given.items() if k in names})[0]
        self.seconds["tokenization"] += encoded - began
        self.seconds["inference"] += perf_counter() - encoded
        if out.shape != (len(passages), 1):
            raise ScoringError(f"the model's output is {out.shape}, not {(len(passages), 1)}")
        return out[:, 0].astype(np.float32)
