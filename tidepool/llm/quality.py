"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` are Catalyst expressions over a text; ``Rule`` rows name a measure, the range it must lie in and the
number of words from which the rule holds. ``compile_rules`` turns the table into one boolean expression, so a new
rule is a new row and the plan stays one projection over one scan.

Defined results: a null or empty text has no words and fails the base rule; a text of any length is measured
whole; repeated rows give repeated results; an empty table gives an empty result; columns other than the id and
the text are not read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was it for on with as be at by that this from are or an "
    "der die das und in zu den von mit ist im des auf ein eine nicht dem es "
    "le la les de des et en un une du que est pour dans qui par sur au ce "
    "el los las que y en un una por con para del se su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [``least``, ``most``] once a text has ``from_words`` words."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The method's own thresholds, beside the base rule of 50 words and half repeated.
RULES = (
    Rule("word_length", "mean_word_chars", least=1.5, most=25.0, from_words=50),
    Rule("symbols", "symbol_ratio", most=0.05, from_words=50),
    Rule("stop_words", "stop_ratio", least=0.01, from_words=50),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5, from_words=50),
)


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text as Catalyst expressions, by name, each from those before it.

    n_repeat_words: a window of three words is a struct (hash of its words, place). Sorted, windows found twice
    stand side by side; each then covers the distance to the next one's place, three at most.
    """
    c, lit = F.col, F.lit
    lines = F.filter(F.split(F.coalesce(text, lit("")), "\n", -1), lambda x: x.rlike(WORD))
    grams = F.expr(
        "CASE WHEN size(__w) < 3 THEN array() ELSE transform(slice(__w, 3, size(__w)), (x, i) -> xxhash64(__w[i], __w[i + 1], x)) END"
    ).cast("array<bigint>")
    return {
        "__w": F.regexp_extract_all(F.coalesce(text, lit("")), lit(WORD), 0),
        "__lines": lines,
        "__g": grams,
        "__s": F.expr("CASE WHEN size(array_distinct(__g)) < size(__g) THEN sort_array(transform(__g, (h, i) -> struct(h, i))) END"),
        "__p": F.expr("sort_array(transform(filter(__s, (x, k) -> (k > 0 AND __s[k - 1].h = x.h) OR (k + 1 < size(__s) AND __s[k + 1].h = x.h)), x -> x.i))"),
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(F.coalesce(text, lit("")), rf"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(
            "coalesce(aggregate(__p, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n), 0L)"
        ).cast("long"),
        "n_stop_words": F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "mean_word_chars": c("word_chars") / F.greatest(c("n_words"), lit(1)),
        "symbol_ratio": c("n_symbols") / F.greatest(c("word_chars"), lit(1)),
        "stop_ratio": c("n_stop_words") / F.greatest(c("n_words"), lit(1)),
        "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), lit(1)),
    }


def base_failed(words: Column, repeat_words: Column) -> Column:
    return (words < 50) | (100 * repeat_words > 50 * words)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule holds."""
    kept = F.lit(True)
    for rule in rules:
        held = F.lit(True)
        if rule.least is not None:
            held = held & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            held = held & (F.col(rule.measure) <= rule.most)
        kept = kept & ((F.col("n_words") < rule.from_words) | held)
    return kept


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that don't hold, comma-joined in the table's order."""
    return F.array_join(F.array(*[F.when(~compile_rules((r,)), F.lit(r.name)) for r in rules]), ",")


def _judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``df``, which has the text as __text, with all measures, base_failed, failed_rules and kept.

    Catalyst would push a later filter on these columns below the projections and spell out every measure again for each
    use of it. It pushes nothing through columns that it can't repeat, so each reads a running number, which is never negative.
    """
    found = measures(F.col("__text"))
    names = [*df.columns, *(n for n in found if not n.startswith("__")), "base_failed", "failed_rules", "kept"]
    for name, column in found.items():
        df = df.withColumn(name, column)
    df = df.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    df = df.withColumn("failed_rules", failed_rules(rules)).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    once = F.monotonically_increasing_id() >= 0
    return df.select(*[F.when(once, F.col(n)).alias(n) for n in names])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: the id, all counts and ratios, base_failed, failed_rules and kept."""
    out = _judged(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), rules)
    return out.withColumnRenamed("__id", id_col).drop("__text")


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df``, all columns, whose text is kept, in one pass over ``df``."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    out = df.toDF(*names)
    out = _judged(out.withColumn("__text", F.col(names[df.columns.index(text_col)])), rules)
    return out.where("kept").select(*names).toDF(*df.columns)
