"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped and probed by binary search.

A rule is a verdict and ``host/path``. It fits its host and all subdomains where the url's path starts with its path;
the longest rule that fits wins. A url's candidates are its host's suffixes joined to its path's prefixes of the lengths
that rules have. All candidates of a batch are hashed, looked up in the mapped digests by one vectorised binary search,
and a digest that is found is confirmed against the stored full string, which is mapped too, so a collision can't judge a url.

The digests and strings travel as a broadcast of at most ``block_rules`` rules; each Python worker maps its copy from an
unnamed temporary file of its own, so nothing stays behind and no folder has to be shared. More rules are probed
block by block, a stated rule set against all pages, and the longest rule of all blocks wins by ``max`` over a page.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; a url of any length is
judged whole; equal urls get equal verdicts; an empty rule table leaves every page with the default verdict; of rules
with equal strings, and of fitting rules of equal length, block wins, then the last by its characters; columns other than id and url are not read, so their names can't clash.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.shipping import ship

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END, _PATH_END = re.compile("[/?#]"), re.compile("[?#]")


def parse(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = _HOST_END.search(rest)
    end = at.start() if at else len(rest)
    stop = _PATH_END.search(rest, end)
    return rest[:end].translate(_LOWER), rest[end : stop.start() if stop else len(rest)]


class DigestArray:
    """Sorted xxhash64 digests of rule strings, with the strings and verdicts in the same order, as bytes that a worker maps."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        by_rule: dict[str, str] = {}
        for verdict, rule in rules:
            by_rule[rule] = "block" if "block" in (verdict, by_rule.get(rule)) else verdict
        rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in by_rule.items())
        self.n = len(rows)
        self.verdicts = sorted({v for *_, v in rows})
        self.path_lengths = sorted({len(r) - r.index("/") if "/" in r else 0 for r in by_rule})
        self.bytes = b"".join(
            [
                np.array([d for d, *_ in rows], np.uint64).tobytes(),
                np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype(np.uint64).tobytes(),
                np.array([self.verdicts.index(v) for *_, v in rows], np.uint8).tobytes(),
                *(r for _, r, _ in rows),
            ]
        )

    def mapped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests, strings' offsets, verdicts' numbers and strings, mapped from an unnamed file of this worker."""
        with tempfile.TemporaryFile() as f:
            f.write(self.bytes)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        a, b, c = 8 * self.n, 16 * self.n + 8, 17 * self.n + 8
        return whole[:a].view(np.uint64), whole[a:b].view(np.uint64), whole[b:c], whole[c:]

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """Strings that a fitting rule can have."""
        paths = [path[:n] for n in self.path_lengths if n <= len(path)]
        at = 0
        while host:
            for p in paths:
                yield host[at:] + p
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1

    def longest(self, parsed: list[tuple[str, str]], mapped: tuple) -> list[tuple[int, bool, str, str] | None]:
        """For each (host, path) the rule that wins, as (length, blocks, rule, verdict): the longest that fits, of these one that blocks,
        of these the last by its characters."""
        names, owner = [], []
        for k, (host, path) in enumerate(parsed):
            for name in self.candidates(host, path):
                names.append(name)
                owner.append(k)
        out: list[tuple[int, bool, str, str] | None] = [None] * len(parsed)
        digests, offsets, verdicts, strings = mapped
        if not names or not self.n:
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(n.encode()) for n in names), np.uint64, len(names))
        first = np.searchsorted(digests, keys, "left")
        for k in np.flatnonzero(digests[np.minimum(first, self.n - 1)] == keys).tolist():
            rule, name = int(first[k]), names[k].encode()
            while rule < self.n and digests[rule] == keys[k]:
                if strings[int(offsets[rule]) : int(offsets[rule + 1])].tobytes() == name:
                    verdict = self.verdicts[verdicts[rule]]
                    here = (len(names[k]), verdict == "block", names[k], verdict)
                    held = out[owner[k]]
                    if held is None or here > held:
                        out[owner[k]] = here
                    break
                rule += 1
        return out


def _prober(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: DigestArray = shared.value
        mapped = index.mapped()
        for batch in batches:
            parsed = [parse(u) for u in batch.column(1).to_pylist()]
            found = index.longest(parsed, mapped)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parsed], pa.string()),
                    pa.array([p for _, p in parsed], pa.string()),
                    pa.array([x and x[2] for x in found], pa.string()),
                    pa.array([x and x[3] for x in found], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return run


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    default: str = "allow", block_rules: int = 2_000_000,
) -> DataFrame:
    """One row per page: id, host, path, rule (null without one) and verdict (``default`` without a rule)."""
    ship(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = narrow.schema["id"].dataType.simpleString()
    parts = []
    for lo in range(0, max(len(rules), 1), block_rules):
        shared = pages.sparkSession.sparkContext.broadcast(DigestArray(rules[lo : lo + block_rules]))
        parts.append(narrow.mapInArrow(_prober(shared), f"id {kind}, host string, path string, rule string, verdict string"))
    out = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("verdict").eqNullSafe("block").alias("b"), "rule", "verdict")))
        copies = F.count("*") / len(parts)  # pages that repeat
        out = out.groupBy("id", "host", "path").agg(best.alias("best"), copies.cast("int").alias("copies"))
        out = out.select("id", "host", "path", "best.rule", "best.verdict", F.explode(F.sequence(F.lit(1), "copies")).alias("k")).drop("k")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
