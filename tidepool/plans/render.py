"""A report as a JSON document or text. Only the top-k rows reach the driver."""

from __future__ import annotations

import base64
import json

from tidepool.functions.text import escape_controls
from tidepool.operators.search import Report

SCHEMA_VERSION = 1


def path_fields(path: str | None, root: str, raw: bytes | None = None) -> dict:
    if path is None:
        return {"path": None, "path_display": (raw or b"").decode("utf-8", "replace"), "path_bytes_base64": base64.b64encode(raw or b"").decode()}
    short = path[len(root) :].lstrip("/") if root and path.startswith(root) else path
    return {"path": short, "path_display": short}


def document(report: Report, query: str, root: str = "", passages: dict[int, str] | None = None, diagnostics: list[dict] | None = None, stats: dict | None = None, model: dict | None = None) -> dict:
    """The output document: absent counters are left out, ``model`` and ``scoring_complete`` may be null."""
    results, out = [], list(diagnostics or [])
    for row in report.results.orderBy("rank").collect():
        logit = row.asDict().get("relevance_logit")
        if passages is not None and row.chunk_index not in passages:
            raise KeyError(f"result {row.rank} has no passage (chunk {row.chunk_index})")
        text = (passages or {}).get(row.chunk_index, "")
        results.append(path_fields(row.path, root) | {
            "start_byte": row.start_byte, "end_byte": row.end_byte, "start_line": row.start_line, "end_line": row.end_line,
            "kind": "lexical_chunk" if report.mode == "lexical" else "model_reranked_chunk",
            "score": row.score if logit is None else float(logit), "score_kind": "bm25" if logit is None else "raw_logit",
            "snippet": text if len(text) <= 500 else text[:500] + "…",
        })
    held = {"scan_complete": True, "partial": False} | (stats or {})
    held |= {
        "lexical_evidence": report.lexical_evidence, "scoring_complete": report.scoring_complete, "chunks_total": report.chunks_total,
        "chunks_selected": report.chunks_evaluated, "chunks_evaluated": report.chunks_evaluated, "results_returned": len(results), "deduplicated_count": report.deduplicated_count,
    }
    if report.selection is not None and report.selection.counts is not None:
        held["candidate_selection"] = {"quota": report.selection.quota} | {f"{k}_selected": v for k, v in report.selection.counts.items()}
    for kind, said, shown in (
        ("scan_incomplete", "the scan did not finish", not held["scan_complete"]), ("partial_results", "some files were not searched", held["partial"]),
        ("scoring_incomplete", "only candidates were scored", report.scoring_complete is False), ("no_lexical_evidence", "no query term occurs", not report.lexical_evidence),
    ):
        if shown:
            out.append({"kind": kind, "message": said})
    return {"schema_version": SCHEMA_VERSION, "query": query, "root": path_fields(root, ""), "mode": report.mode, "model": model, "results": results, "stats": held, "diagnostics": out}


def to_json(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def to_text(doc: dict) -> str:
    lines = []
    for k, r in enumerate(doc["results"], 1):
        lines.append(f"{k}. {escape_controls(r['path_display'])}:{r['start_line']}-{r['end_line']} ({r['score_kind']} {r['score']:.4f})")
        lines += [f"   {escape_controls(x)}" for x in r["snippet"].split("\n")]
    lines += [f"note: {d['kind']}: {escape_controls(d['message'])}" for d in doc["diagnostics"]]
    return "\n".join(lines or ["no results"])


def exit_code(doc: dict) -> int:
    """3 for partial results, 1 for none, 0 otherwise."""
    return 3 if doc["stats"]["partial"] else 0 if doc["results"] else 1
