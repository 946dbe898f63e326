"""Spans of a run as lines of JSON: names, times, ids and numbers, never questions, texts or answers."""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path


class Trace:
    """Writes where it can and is silent where it cannot: a run does not fail because its trace does."""

    def __init__(self, path: str | None, metadata: Mapping[str, object] | None = None):
        self.path, self.metadata, self.run_id = path, dict(metadata or {}), uuid.uuid4().hex
        self.usage: dict[str, dict[str, int]] = {}

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], metadata: Mapping[str, object] | None = None) -> Trace:
        """A trace into TESSERA_TRACE, unless TESSERA_TRACE_ENABLED says no or the file cannot be written."""
        path = settings.get("TESSERA_TRACE", "").strip()
        if not path or settings.get("TESSERA_TRACE_ENABLED", "true").lower() in ("false", "0", "no"):
            return cls(None, metadata)
        try:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            with open(path, "a"):
                pass
        except OSError as e:
            warnings.warn(f"no trace is kept: {e}", stacklevel=2)
            return cls(None, metadata)
        return cls(path, metadata)

    @property
    def active(self) -> bool:
        return self.path is not None

    def write(self, row: Mapping[str, object]) -> None:
        if self.path is None:
            return
        try:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps({"run": self.run_id, **row}, ensure_ascii=False) + "\n")
        except OSError as e:
            warnings.warn(f"a span is lost: {e}", stacklevel=2)

    @contextmanager
    def span(self, name: str, **details: object) -> Iterator[dict]:
        """Times a step; the caller may add numbers and ids. An error is recorded by its kind alone, and goes on."""
        began, more = time.time(), dict(details)
        try:
            yield more
        except BaseException as e:
            more["error"] = type(e).__name__
            raise
        finally:
            self.write({"span": name, "seconds": round(time.time() - began, 3), **more})

    def retrieval(self, hits: list[Mapping[str, object]]) -> None:
        self.write({"span": "retrieval-results", "hits": [{k: h[k] for k in ("q_id", "doc_id", "chunk_id", "score")} for h in hits]})

    def scores(self, summary: Mapping[str, object]) -> None:
        for name, value in summary.items():
            if isinstance(value, int | float) and not isinstance(value, bool):
                self.write({"score": name, "value": float(value)})

    def tokens(self, model: str, counts: Mapping[str, int]) -> None:
        own = self.usage.setdefault(model, {})
        for k, n in counts.items():
            own[k] = own.get(k, 0) + int(n)
