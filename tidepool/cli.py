"""``python -m tidepool.cli QUERY [ROOT]``: searches a tree and prints the report."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from time import perf_counter

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidepool.operators import chunking, contracts, fitting, models, scoring
from tidepool.operators.search import search
from tidepool.plans import render, store
from tidepool.sources import tree

#: Diagnostics that a report shows, failures first; all are counted.
MOST_DIAGNOSTICS = 1000
CACHE = os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "tidepool")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidepool")
    p.add_argument("query", nargs="?")
    p.add_argument("root", nargs="?", default=".")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--deep", action="store_true")
    mode.add_argument("--lexical", action="store_true")
    p.add_argument("--model", help="folder with model.onnx and tokenizer.json, or a profile of the registry")
    p.add_argument("--registry", help="TOML file of model profiles")
    p.add_argument("--cache-dir", default=CACHE, help="folder of the profiles' files")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--candidates", type=int)
    p.add_argument("--batch-size", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--glob", action="append", default=[])
    p.add_argument("--max-file-size", type=int, default=tree.MAX_FILE)
    p.add_argument("--max-total-bytes", type=int, default=tree.MAX_TOTAL)
    p.add_argument("--max-chunks", type=int, default=50_000)
    p.add_argument("--threads", type=int)
    return p


def check(args: argparse.Namespace) -> None:
    if args.lexical and any(x is not None for x in (args.model, args.candidates, args.batch_size, args.threads)):
        raise ValueError("--lexical takes no model options")
    if args.deep and args.candidates is not None:
        raise ValueError("--deep takes no --candidates")
    if not args.lexical and not args.model:
        raise ValueError("fast and deep searches need --model")
    for name in ("top_k", "candidates", "batch_size", "threads", "max_chunks", "max_file_size", "max_total_bytes"):
        value = getattr(args, name)
        if value is not None and value < 1:
            raise ValueError(f"--{name.replace('_', '-')} must be at least 1")


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    took, began = {}, perf_counter()
    found = store.written(tree.read_tree(
        spark, args.root, globs="\n".join(args.glob), hidden=args.hidden, ignore=not args.no_ignore, max_file_bytes=args.max_file_size, max_total_bytes=args.max_total_bytes
    ))
    counts = tree.counters(found)
    told = found.where(~F.col("kind").isin("ok", "entries_seen")).select("kind", "path", "path_bytes", "message")
    shown = told.orderBy(F.col("kind").isin(*tree.POLICY), "path").limit(MOST_DIAGNOSTICS).collect()  # failures first
    diagnostics = [{"kind": r.kind, "message": r.message} | render.path_fields(r.path, args.root, bytes(r.path_bytes)) for r in shown]
    more = counts["policy_exclusions_observed"] + counts["failures"] - len(shown)
    if more > 0:
        diagnostics.append({"kind": "more_diagnostics", "message": f"{more} more were counted"})
    took["discovery"], began = round(1000 * (perf_counter() - began)), perf_counter()
    sources = found.where("kind = 'ok'").select("source_id", "path", "text")
    chunks = chunking.chunk(sources)
    scorer, split, reached = None, 0, False
    if args.lexical:
        numbered = store.written(chunking.number(chunks, args.max_chunks + 1))
        reached = numbered.count() > args.max_chunks
        numbered = numbered.where(F.col("chunk_index") < args.max_chunks)
    else:
        folder, profile = models.resolve(args.model, models.load(args.registry) if args.registry else {}, args.cache_dir)
        limits = {k: profile.fields[f"max_{k}_tokens"] for k in ("query", "pair")} if profile else {"query": 64, "pair": 256}
        scorer = scoring.OnnxScorer(folder, limits["query"], limits["pair"], threads=args.threads or 4, profile=profile)
        numbered, split, reached = fitting.fit_all(sources, store.written(chunks), args.query, scorer.pair_limit, args.max_chunks, scorer.pair_length)
        numbered = store.written(numbered.drop("pieces"))
    contracts.require(contracts.index_problems(numbered), "chunks are numbered twice")
    if split:
        diagnostics.append({"kind": "model_pair_split", "message": f"{split} chunks were split to fit the model's limit on pairs"})
    if reached:
        diagnostics.append({"kind": "chunk_limit_reached", "message": f"only {args.max_chunks} chunks were searched"})
    took["chunking"], began = round(1000 * (perf_counter() - began)), perf_counter()
    mode = "lexical" if args.lexical else "deep" if args.deep else "fast"
    report = search(numbered, args.query, mode, args.top_k, args.candidates or 128, scorer, batch_size=args.batch_size or 1)
    took["search"] = round(1000 * (perf_counter() - began))
    ids = [r.chunk_index for r in report.results.select("chunk_index").collect()]
    passages = {r.chunk_index: r.passage for r in numbered.where(F.col("chunk_index").isin(ids)).select("chunk_index", "passage").collect()}
    partial = bool(counts["failures"]) or reached
    stats = counts | {"scan_complete": not counts["failures"], "partial": partial, "timing": took | report.timings_ms}
    return render.document(report, args.query, args.root, passages, diagnostics, stats)


def model_command(args: argparse.Namespace) -> int:
    """``model list`` and ``model verify PROFILE`` of a registry, against the files of a cache."""
    profiles = models.load(args.registry)
    if args.action == "verify":
        folder, profile = models.resolve(args.profile, profiles, args.cache_dir)
        print(f"verified model {profile.id if profile else args.profile} in {folder} ({len(profile.artifacts) if profile else 0} artifacts)")
        return 0
    rows = []
    for name, p in sorted(profiles.items()):
        folder = models.cache_folder(p, args.cache_dir)
        rows.append({"id": name, "repository": p.fields["repository"], "revision": p.fields["revision"], "license": p.fields["license"], "installed": not models.verify(p, folder), "directory": folder})
    if args.json:
        print(json.dumps({"schema_version": 1, "profiles": rows}))
    else:
        for r in rows:
            print("\t".join([r["id"], "verified" if r["installed"] else "not prepared", r["revision"], r["directory"]]))
    return 0


def doctor_command(args: argparse.Namespace) -> int:
    """What a model search needs and whether it is there; 1 if not."""
    rows = models.doctor(models.load(args.registry) if args.registry else {}, args.cache_dir)
    if args.json:
        print(json.dumps({"schema_version": 1, "platform": platform.system().lower(), "architecture": platform.machine(), "checks": [{"check": c, "ready": g, "detail": d} for c, g, d in rows]}))
    else:
        for c, good, detail in rows:
            print(f"{c}: {'ready' if good else 'not ready'} ({detail})")
    return 0 if all(good for _, good, _ in rows) else 1


def command(argv: list[str]) -> int:
    """The commands beside a search: ``model`` and ``doctor``."""
    p = argparse.ArgumentParser(prog=f"tidepool {argv[0]}")
    if argv[0] == "model":
        p.add_argument("action", choices=("list", "verify"))
        p.add_argument("profile", nargs="?")
    p.add_argument("--registry", required=argv[0] == "model")
    p.add_argument("--cache-dir", default=CACHE)
    p.add_argument("--json", action="store_true")
    args = p.parse_args(argv[1:])
    if argv[0] == "model" and args.action == "verify" and not args.profile:
        p.error("model verify needs a profile")
    try:
        return (model_command if argv[0] == "model" else doctor_command)(args)
    except (models.RegistryError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] in ("model", "doctor"):
        return command(argv)
    p = parser()
    args = p.parse_args(argv)
    if args.query is None:
        p.print_help()
        return 0
    try:
        check(args)
        spark = SparkSession.builder.appName("tidepool").config("spark.ui.enabled", "false").getOrCreate()
        doc = run(spark, args)
    except (ValueError, OSError, KeyError, scoring.ScoringError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(render.to_json(doc) if args.json else render.to_text(doc))
    return render.exit_code(doc)


if __name__ == "__main__":
    sys.exit(main())
