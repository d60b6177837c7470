"""License scans: ordered signature rules, gated by keywords, resolved by priority and interval containment.

All on DataFrame functions, in one projection without a shuffle. A text with any rule's keyword among its words becomes
its lower-cased words with a blank behind each; every rule whose keyword stands there is matched, and its matches' word places
follow from the pieces between them. Spans, sorted by start, larger ones first, are folded once: the furthest end so far
is held for each priority, and a span that an equal or higher priority has covered is suppressed.

Defined results: a null, empty or word-less text has no words, no labels and score 0; a text of any length is scanned
whole; equal spans keep the first rule of the highest priority; repeated rows get equal results; an empty table gives
an empty result; columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.license_rules import BASE, RULES

#: Words after lower-casing. Lower case of other letters than A-Z makes or unmakes none of these, nor a base phrase.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A base phrase is gated by a word that is not one of these.
_COMMON = frozenset("a all an and by for in is of on or the to".split())
STRENGTH = {3: 1.0, 2: 0.8, 1: 0.5}

Rule = tuple[str, int, str, str]


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = tuple(RULES), base: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_words, base spans (``base_spans``) and kept ``detections`` (rule, label,
    priority, first and end word), of which labels and score follow."""
    base = BASE if base is None else base
    every = [(label, 0, min(phrase.split(), key=_COMMON.__contains__), phrase) for phrase, label in base.items()] + list(rules)
    table = "array(" + ",".join(
        f"named_struct('rule', {k - len(base)}, 'label', {_text(label)}, 'priority', {p}, 'keys', array({','.join(_text(k) for k in keyword.split('/'))}), 're', {_text(f'(?<![^ ])(?:{re}) ')})"
        for k, (label, p, keyword, re) in enumerate(every)
    ) + ")"
    keywords = sorted({k for _, _, keyword, _ in every for k in keyword.split("/")})
    out = df.select(F.col(id_col).alias("__id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    out = out.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), 0))
    out = out.withColumn("__found", F.array_intersect("__words", F.array(*[F.lit(k) for k in keywords])))
    out = out.withColumn("__norm", F.when(F.size("__found") > 0, F.concat(F.array_join("__words", " "), F.lit(" "))))
    wc = "(length({0}) - length(replace({0}, ' ', '')))"
    out = out.withColumn("__hits", F.expr(f"""
        transform(
          filter(
            transform(filter({table}, r -> __norm IS NOT NULL AND arrays_overlap(__found, r.keys)),
                      r -> named_struct('r', r, 'm', regexp_extract_all(__norm, r.re, 0))),
            h -> size(h.m) > 0),
          h -> named_struct('r', h.r, 'm', h.m, 'p', split(__norm, h.r.re, -1)))"""))
    spans = f"""
        flatten(transform(__hits, h -> aggregate(
          zip_with(h.m, slice(h.p, 1, size(h.m)), (m, p) -> struct(m, p)),
          named_struct('at', 0, 'out', CAST(array() AS array<struct<first:int,tail:int,order:int,rule:int,label:string>>)),
          (a, x) -> named_struct(
            'at', a.at + {wc.format('x.p')} + {wc.format('x.m')},
            'out', array_append(a.out, named_struct(
              'first', a.at + {wc.format('x.p')}, 'tail', -(a.at + {wc.format('x.p')} + {wc.format('x.m')}),
              'order', -h.r.priority, 'rule', h.r.rule, 'label', h.r.label))),
          a -> a.out)))"""
    out = out.withColumn("__spans", F.expr(f"sort_array({spans})"))
    kept = """
        aggregate(filter(__spans, s -> s.rule >= 0),
          named_struct('e1', -1, 'e2', -1, 'e3', -1, 'out', CAST(array() AS array<struct<rule:int,label:string,priority:int,first:int,end:int>>)),
          (a, s) -> named_struct(
            'e1', greatest(a.e1, -s.tail),
            'e2', IF(s.order <= -2, greatest(a.e2, -s.tail), a.e2),
            'e3', IF(s.order <= -3, greatest(a.e3, -s.tail), a.e3),
            'out', IF(-s.tail <= CASE s.order WHEN -3 THEN a.e3 WHEN -2 THEN a.e2 ELSE a.e1 END, a.out,
                      array_append(a.out, named_struct('rule', s.rule, 'label', s.label, 'priority', -s.order, 'first', s.first, 'end', -s.tail)))),
          a -> a.out)"""
    return out.select(
        F.col("__id").alias(id_col),
        F.size("__words").cast("long").alias("n_words"),
        F.coalesce(F.expr("transform(filter(__spans, s -> s.rule < 0), s -> named_struct('first', s.first, 'label', s.label))"), F.expr("CAST(array() AS array<struct<first:int,label:string>>)")).alias("base_spans"),
        F.coalesce(F.expr(kept), F.expr("CAST(array() AS array<struct<rule:int,label:string,priority:int,first:int,end:int>>)")).alias("detections"),
    )


def labelled(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and the score of :func:`scan`'s rows."""
    first = F.expr("transform(base_spans, s -> s.first)")
    base = F.expr("transform(base_spans, s -> s.label)")
    own = F.expr("transform(detections, s -> s.label)")
    strength = "CASE array_max(transform(detections, s -> s.priority)) " + " ".join(f"WHEN {p} THEN {v}D" for p, v in STRENGTH.items()) + " ELSE 0D END"
    others = [c for c in scanned.columns if c not in ("base_spans", "detections")]
    return scanned.select(
        *others,
        F.size("base_spans").cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"),
        F.array_max(first).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.expr(strength).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
