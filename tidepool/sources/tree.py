"""A directory tree as a Spark data source: ``spark.read.format("tree").option("root", ...)``.

The driver lists the tree under the ignore, hidden and glob rules; readers take slices of the list and read each file as a
snapshot: a file that changes while it is read is refused, as are NUL bytes and invalid UTF-8. For a root that all executors
can open, as with any file source.
"""

from __future__ import annotations

import fnmatch
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepool.sources.tables import glob_regex

MAX_FILE, MAX_TOTAL = 2 << 20, 64 << 20
SCHEMA = "source_id long, path string, path_bytes binary, text string, len_bytes long, kind string, message string"


class DiscoveryError(ValueError):
    """The root can't be walked."""


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    negated: bool
    only_dirs: bool

    @classmethod
    def parse(cls, line: str) -> Pattern | None:
        line = line.rstrip("\n").rstrip("\r")
        if not line.strip() or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated or line.startswith("\\") else line
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = "".join(_piece(p) for p in re.split(r"(\*\*/|/\*\*|\*\*)", line.lstrip("/")))
        return cls(re.compile(body if anchored else f"(?:.*/)?{body}"), negated, only_dirs)


def _piece(p: str) -> str:
    if p == "**/":
        return "(?:.*/)?"
    if p == "/**":
        return "/.*"
    if p == "**":
        return ".*"
    return re.sub(r"\\Z$|\(\?s:|\)\\[Zz]$", "", fnmatch.translate(p)).replace(".*", "[^/]*") if p else ""


@dataclass
class Rules:
    """Patterns of one folder's ignore files, later ones first in force."""

    folder: str
    patterns: list[Pattern] = field(default_factory=list)

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        relative = os.path.relpath(path, self.folder)
        for p in reversed(self.patterns):
            if (is_dir or not p.only_dirs) and p.regex.fullmatch(relative):
                return not p.negated
        return None


def read_rules(folder: str, names: tuple[str, ...], diagnostics: list[tuple[str, str, str]] | None = None, at: str | None = None) -> Rules:
    """Rules of the ignore files ``names`` in a folder, for paths below ``at`` (the folder). A file that is there and can't be read is told."""
    out = Rules(at or folder)
    for name in names:
        path = os.path.join(folder, name)
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                out.patterns += [p for p in map(Pattern.parse, f) if p]
        except (FileNotFoundError, NotADirectoryError):
            continue
        except (OSError, re.error) as e:
            if diagnostics is not None:
                diagnostics.append(("ignore_rule_failure", path, str(e)))
    return out


def global_rules(diagnostics: list[tuple[str, str, str]], at: str) -> Rules:
    """Rules of the user's global ignore file: core.excludesFile of the git configuration, else git/ignore of the configuration folder."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    path = os.path.join(home, "git", "ignore")
    for config in (os.path.join(home, "git", "config"), os.path.expanduser("~/.gitconfig")):
        try:
            with open(config, encoding="utf-8", errors="replace") as f:
                section = ""
                for line in f:
                    section = line.strip().lower() if line.lstrip().startswith("[") else section
                    name, _, value = line.partition("=")
                    if section == "[core]" and name.strip().lower() == "excludesfile":
                        path = os.path.expanduser(value.strip().strip('"'))
        except OSError:
            continue
    return read_rules(os.path.dirname(path), (os.path.basename(path),), diagnostics, at)


@dataclass
class Listing:
    files: list[str] = field(default_factory=list)
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)
    seen: int = 0  # entries that no rule left out


def check_root(root: str) -> None:
    """A root is a folder or a regular file, and neither it nor a folder above it a symbolic link."""
    at = root
    while True:
        if os.path.islink(at):
            raise DiscoveryError(f"{at} is a symbolic link")
        up = os.path.dirname(os.path.abspath(at))
        if up == os.path.abspath(at):
            break
        at = up
    if not os.path.exists(root):
        raise DiscoveryError(f"{root} does not exist")
    if not os.path.isdir(root) and not os.path.isfile(root):
        raise DiscoveryError(f"{root} is neither a folder nor a file")


def listing(root: str, globs: list[str] | None = None, hidden: bool = False, ignore: bool = True) -> Listing:
    """Candidate files below a root, sorted by path components, and what was left out."""
    check_root(root)
    out = Listing()
    wanted = [re.compile(glob_regex(g)) for g in globs or []]

    def offer(path: str, name: str) -> None:
        if wanted and not any(w.match(name) for w in wanted):
            out.diagnostics.append(("glob_filtered", path, "no pattern matches"))
        else:
            out.files.append(path)

    if ".git" in os.path.abspath(root).split("/"):
        out.diagnostics.append(("git_metadata", root, "inside .git"))
        return out
    if os.path.isfile(root):
        offer(root, os.path.basename(root))
        return out
    chain, up, git = [], os.path.abspath(root), None
    while ignore:
        git = git or (up if os.path.exists(os.path.join(up, ".git")) else None)
        if os.path.dirname(up) == up:
            break
        up = os.path.dirname(up)
        chain.append(up)
    names = ((".gitignore",) if git else ()) + (".ignore",)
    rules = []
    if git:  # rules of the user, then of the repository, come before those of folders
        rules = [global_rules(out.diagnostics, git), read_rules(os.path.join(git, ".git", "info"), ("exclude",), out.diagnostics, git)]
    rules += [read_rules(f, names, out.diagnostics) for f in reversed(chain)] if ignore else []

    def walk(folder: str, inherited: list[Rules]) -> None:
        own = inherited + ([read_rules(os.path.abspath(folder), names, out.diagnostics)] if ignore else [])
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            out.diagnostics.append(("traversal_failure", folder, str(e)))
            return
        for e in entries:
            if e.name == ".git":
                out.diagnostics.append(("git_metadata", e.path, "always left out"))
                continue
            if e.name.startswith(".") and not hidden:
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            verdicts = (r.verdict(os.path.abspath(e.path), is_dir) for r in reversed(own))
            if next((v for v in verdicts if v is not None), False):
                continue
            out.seen += 1
            if e.is_symlink():
                out.diagnostics.append(("symlink", e.path, "symbolic links are not followed"))
            elif is_dir:
                walk(e.path, own)
            elif not e.is_file(follow_symlinks=False):
                out.diagnostics.append(("not_regular_file", e.path, "not a regular file"))
            else:
                offer(e.path, os.path.relpath(e.path, root))

    walk(root, rules)
    out.files = sorted(dict.fromkeys(out.files), key=lambda p: p.split("/"))
    return out


def snapshot(path: str, most: int) -> tuple[str | None, str, str, int | None]:
    """(text, kind, message, bytes read) of a file; the kind is ok or why it is refused."""
    try:
        before = os.lstat(path)
        if not stat.S_ISREG(before.st_mode):
            return None, "changed_during_read", "no longer a regular file", None
        if before.st_size > most:
            return None, "file_too_large", f"{before.st_size} bytes", None
        with open(path, "rb") as f:
            raw = f.read(most + 1)
            after = os.fstat(f.fileno())
        mark = lambda s: (s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino)
        if mark(before) != mark(after) or mark(os.lstat(path)) != mark(before) or len(raw) != before.st_size:
            return None, "changed_during_read", "size, time or identity changed", len(raw)
    except OSError as e:
        return None, "read_failure", str(e), None
    if b"\0" in raw:
        return None, "nul_byte", "has a NUL byte", len(raw)
    try:
        return raw.decode("utf-8"), "ok", "", len(raw)
    except UnicodeDecodeError as e:
        return None, "invalid_utf8", str(e), len(raw)


class _Slice(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.globs = [g for g in options.get("globs", "").split("\n") if g]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.ignore = options.get("ignore", "true").lower() == "true"
        self.max_file = int(options.get("max_file_bytes", MAX_FILE))
        self.max_total = int(options.get("max_total_bytes", MAX_TOTAL))
        self.slices = int(options.get("slices", 64))
        for name in ("max_file", "max_total", "slices"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def partitions(self):
        found = listing(self.root, self.globs, self.hidden, self.ignore)
        rows, used, stopped = [], 0, False
        for path in found.files:
            size = os.lstat(path).st_size
            if stopped or (size <= self.max_file and used + size > self.max_total):
                if not stopped:
                    found.diagnostics.append(("total_byte_limit", path, f"more than {self.max_total} bytes in all"))
                stopped = True
                break
            used += size if size <= self.max_file else 0
            rows.append((len(rows), path, None, None))
        rows += [(None, p, k, m) for k, p, m in found.diagnostics]
        rows.append((None, self.root, "entries_seen", str(found.seen)))
        step = max(1, -(-len(rows) // self.slices))
        return [_Slice(rows[k : k + step]) for k in range(0, len(rows), step)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for number, path, kind, message in partition.rows:
            text = size = None
            if kind is None:
                text, kind, message, size = snapshot(path, self.max_file)
            raw = os.fsencode(path)
            shown = path if raw.decode("utf-8", "replace") == path else None
            yield number, shown, raw, text, size, kind, message


class TreeSource(DataSource):
    """Files (kind ok, with a text), diagnostics (other kinds) and a row of kind entries_seen. ``source_id`` counts candidates in path order."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


#: What leaves a file out without making the results partial.
POLICY = ("git_metadata", "symlink", "not_regular_file", "glob_filtered", "nul_byte", "invalid_utf8")
_UNREAD = ("file_too_large", "read_failure")


def counters(found) -> dict[str, int]:
    """Counts of a scan, from one aggregation of :func:`read_tree`'s rows."""
    from pyspark.sql import functions as F

    kind, tried = F.col("kind"), F.col("source_id").isNotNull()
    row = found.agg(
        F.sum(F.when(kind == "entries_seen", F.col("message").cast("long"))).alias("entries_seen"), F.count_if(tried).alias("files_considered"),
        F.count_if(tried & ~kind.isin(*_UNREAD)).alias("files_read"), F.count_if(kind == "ok").alias("files_accepted"), F.coalesce(F.sum("len_bytes"), F.lit(0)).alias("bytes_read"),
        F.count_if(kind.isin(*POLICY)).alias("policy_exclusions_observed"), F.count_if(~kind.isin("ok", "entries_seen", *POLICY)).alias("failures"),
    ).first()
    return row.asDict()


def read_tree(spark, root: str, **options):
    from tidepool.shipping import ship

    check_root(root)
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(root=root, **{k: str(v) for k, v in options.items()}).load()
