"""Terms, token estimates and other text expressions, on Catalyst functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and patterns of the term and token rules.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}"
TERM = r"[\p{IsAlphabetic}\p{N}_]+"
TOKEN = rf"[\p{{IsAlphabetic}}\p{{N}}&&[^{CJK}]]+|[^\p{{IsWhite_Space}}]"
PARTS = (
    r"_+|(?<=[0-9])(?=[\p{IsAlphabetic}\p{N}&&[^0-9]])|(?<=[\p{IsAlphabetic}\p{N}&&[^0-9]])(?=[0-9])"
    r"|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
)
WHITE_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """NFKC; only texts beyond ASCII travel to Python."""
    plain = text.rlike(r"\A\p{ASCII}*\z")
    return F.coalesce(_nfkc(F.when(~plain, text)), text)


def lower(x: Column) -> Column:
    """Lower case of each character by itself: no final sigma."""
    return F.lower(F.replace(x, F.lit("Σ"), F.lit("σ")))


def terms(text: Column, normalize: bool = True) -> Column:
    """Lower-cased identifiers, each followed by those of its parts that differ from it; underscores alone are none."""
    found = F.filter(F.regexp_extract_all(nfkc(text) if normalize else text, F.lit(f"({TERM})"), 1), lambda x: x.rlike("[^_]"))

    def expand(x: Column) -> Column:
        parts = F.transform(F.split(x, PARTS), lower)
        return F.when(x.rlike(r"^\p{Lu}?\p{Ll}+$"), F.array(lower(x))).otherwise(
            F.concat(F.array(lower(x)), F.filter(parts, lambda p: (p != "") & (p != lower(x))))
        )

    return F.flatten(F.transform(found, expand))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order, by the same rules."""
    out: dict[str, None] = {}
    for x in re.findall(r"\w+", unicodedata.normalize("NFKC", query)):
        if not x.strip("_"):
            continue
        whole = "".join(c.lower() for c in x)
        out[whole] = None
        cut = re.sub(r"(?<=[0-9])(?=[^\W0-9_])|(?<=[^\W0-9_])(?=[0-9])", "_", x)
        cut = "".join(("_" if k and _boundary(cut, k) else "") + c for k, c in enumerate(cut))
        for p in re.split("_+", cut):
            p = "".join(c.lower() for c in p)
            if p and p != whole:
                out[p] = None
    return list(out)


def _boundary(s: str, k: int) -> bool:
    return (s[k - 1].islower() and s[k].isupper()) or (s[k - 1].isupper() and s[k].isupper() and k + 1 < len(s) and s[k + 1].islower())


def token_estimate(text: Column) -> Column:
    """Runs of letters and digits, each CJK character and every other visible character count one."""
    return F.size(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)).cast("long")


def snippet(text: Column, most: int = 500) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def escape_controls(text: str) -> str:
    names = {"\n": r"\n", "\r": r"\r", "\t": r"\t", "\0": r"\0"}
    return "".join(names.get(c) or (f"\\u{{{ord(c):04X}}}" if unicodedata.category(c) == "Cc" else c) for c in text)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def coverage(l0: Column, l1: Column, s0: Column, s1: Column) -> Column:
    """Overlap by the label's length."""
    return F.when(l1 > l0, overlap(l0, l1, s0, s1) / (l1 - l0)).otherwise(F.lit(0.0))


def dcg_term(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def path_order(path: Column) -> Column:
    """Sorts paths by components, not by bytes."""
    return F.split(path, "/")
