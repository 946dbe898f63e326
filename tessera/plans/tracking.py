"""Run numbers, reports and freshness of an index. Driver-side; nothing here grows with the data."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Mapping
from pathlib import Path

from tessera.functions.text import markdown_cell


def next_run(database: str, owner: str) -> str:
    """owner-0001, owner-0002, ...; counting is atomic."""
    with sqlite3.connect(database, timeout=30) as db:
        db.execute("CREATE TABLE IF NOT EXISTS counters (owner TEXT PRIMARY KEY, number INTEGER)")
        (number,) = db.execute("INSERT INTO counters VALUES (?, 1) ON CONFLICT (owner) DO UPDATE SET number = number + 1 RETURNING number", (owner,)).fetchone()
    db.close()
    return f"{owner}-{number:04d}"


def normalised_hash(data: bytes) -> str:
    return hashlib.sha256(data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")).hexdigest()


def is_stale(stored: str, data: bytes) -> bool:
    """Whether neither hash of the documents, with line endings normalised or raw, is the stored one."""
    return stored not in (normalised_hash(data), hashlib.sha256(data).hexdigest())


SHARED_SETTINGS = ("embedding_model", "generation_model", "dimension", "chunk_count", "chunk_size", "chunk_overlap", "top_k")


def report(summary: Mapping, settings: Mapping, experiment: Mapping, usage: Mapping[str, Mapping[str, int]], timestamp: str) -> str:
    """A Markdown report of one evaluation, without questions, answers or filters."""
    table = lambda head, rows: ["", f"| {' | '.join(head)} |", "|" + " --- |" * len(head), *(f"| {' | '.join(map(markdown_cell, r))} |" for r in rows)]
    lines = ["# Evaluation", "", f"Time (UTC): {timestamp}", "", "## Experiment", *table(("item", "value"), experiment.items())]
    lines += ["", "## Settings", *table(("item", "value"), [(k, settings.get(k)) for k in SHARED_SETTINGS])]
    lines += ["", "## Metrics", *table(("metric", "value"), summary.items())]
    lines += ["", "## Tokens", *table(("model", "input", "output", "total"), [(m, *(u.get(k, 0) for k in ("input", "output", "total"))) for m, u in usage.items()])]
    return "\n".join(lines) + "\n"


def save_result(folder: str, command: str, experiment_id: str, timestamp: str, result: Mapping) -> Path:
    path = Path(folder) / f"{command}_{experiment_id}_{timestamp}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(result, ensure_ascii=False, indent=2) + "\n", encoding="utf-8", newline="\n")
    return path


def console_lines(answer: str, sources: list[Mapping]) -> list[str]:
    return [answer, *(f"[{s['citation']}] {s['filename']} ({s['doc_id']}, {s['score']:.3f})" for s in sources)]


def comparison(summaries: Mapping[str, Mapping], metrics: tuple[str, ...]) -> str:
    """Metrics by scenario as a Markdown table; a missing value is a dash."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, int | float) else "-"
    rows = [f"| {m} | {' | '.join(cell(s.get(m)) for s in summaries.values())} |" for m in metrics]
    return "\n".join([f"| metric | {' | '.join(summaries)} |", "|" + " --- |" * (len(summaries) + 1), *rows])
