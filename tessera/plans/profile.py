"""Options of the two profiles and how they resolve: argument over environment over default."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace

from tessera.operators.chunking import STRATEGIES, checked


@dataclass(frozen=True)
class Profile:
    name: str
    strategy: str
    min_score: float | None
    rerank_section: bool
    uncap_named: bool
    slots: bool
    neighbor: bool
    signals: bool
    prompt_filters: bool
    rewrite_allowed: bool
    chunk_size: int = 1000
    chunk_overlap: int = 150
    version: int = 3
    embedding_context: str = "none"
    top_k: int = 5
    candidates: int | None = 50
    hybrid: bool = True
    vector_k: int | None = 100
    bm25_k: int | None = 100
    bm25_prefix: bool | None = True
    rrf_k: int | None = 60
    rerank: str = "lexical"
    expand: int | None = 5
    max_per_doc: int | None = 2
    dedup: bool = False
    within_doc: str = "off"
    rewrite: str = "off"


A = Profile("A", "overview_additive", 0.53, True, False, False, False, True, False, False)
B = Profile("B", "structured", 0.40, False, True, True, True, False, True, True)
PROFILES = {"A": A, "B": B}
ALIASES = {"1": "A", "2": "B", "3": "AB", "SERVER": "A", "API": "B", "BOTH": "AB", "SERVER+API": "AB", "A+B": "AB", "A": "A", "B": "B", "AB": "AB"}
CHOICES = {"rerank": ("none", "lexical", "model"), "within_doc": ("off", "residual", "residual+full"), "rewrite": ("off", "only", "both"), "embedding_context": ("none", "project", "project_blend", "table", "section"), "version": (2, 3)}


def scenarios(choice: str) -> list[Profile]:
    """Profiles of a choice by number, name or alias."""
    try:
        return [PROFILES[x] for x in ALIASES[choice.strip().upper()]]
    except KeyError:
        raise ValueError(f"unknown scenario {choice}") from None


def resolve(profile: Profile, arguments: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> Profile:
    """The effective options; those that have no effect become None."""
    given = {k: v for k, v in (arguments or {}).items() if v is not None}
    env = os.environ if environment is None else environment
    for key, kind in Profile.__annotations__.items():
        raw = env.get(f"TESSERA_{key.upper()}")
        if key not in given and raw not in (None, "") and key != "name":
            given[key] = parse(str(kind), raw)
    p = replace(profile, **given)
    checked(p.chunk_size, p.chunk_overlap)
    for key, allowed in CHOICES.items():
        if getattr(p, key) not in allowed:
            raise ValueError(f"{key} must be one of {allowed}")
    if p.strategy not in STRATEGIES[p.name]:
        raise ValueError(f"profile {p.name} has no chunking strategy {p.strategy}")
    if p.top_k < 1:
        raise ValueError("top_k must be 1 or more")
    if p.rewrite != "off" and not p.rewrite_allowed:
        raise ValueError(f"profile {p.name} does not rewrite questions")
    fused, reranked = p.hybrid or p.rewrite != "off", p.rerank != "none"
    pooled = reranked or p.hybrid or p.rewrite == "both"
    return replace(
        p, candidates=p.candidates if pooled else None, vector_k=(p.vector_k if p.hybrid else p.candidates) if fused else None, rrf_k=p.rrf_k if fused else None,
        bm25_k=p.bm25_k if p.hybrid else None, bm25_prefix=p.bm25_prefix if p.hybrid else None, expand=p.expand if reranked else None,
        rerank_section=p.rerank_section and reranked, uncap_named=p.uncap_named and (reranked or p.name == "B"),
    )


def read_settings(path: str | None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of a settings file, if there is one, under the process environment, which wins."""
    out: dict[str, str] = {}
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8-sig") as f:
            for number, line in enumerate(f, 1):
                line = line.strip()
                if not line or line.startswith("#"):
                    continue
                key, sign, value = line.removeprefix("export ").partition("=")
                if not sign or not key.strip():
                    raise ValueError(f"line {number} of {path} is not KEY=VALUE")
                out[key.strip()] = value.strip().strip("\"'")
    return {**out, **(os.environ if environment is None else environment)}


def parse(kind: str, raw: str) -> object:
    low = raw.strip().lower()
    if low in ("none", "off") and "None" in kind:
        return None
    if "bool" in kind:
        return low in ("1", "true", "on", "yes")
    return float(raw) if "float" in kind else int(raw) if "int" in kind else raw


def pool_size(p: Profile) -> int:
    return p.top_k if p.rerank == "none" else max(p.top_k, p.candidates or 0)


def parse_filters(items: list[str], case_filters: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE pairs; the first sign splits, later ones and a case's own filters win."""
    out = {}
    for item in items:
        key, sign, value = item.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"a filter is KEY=VALUE, not {item}")
        out[key.strip()] = value
    return {**out, **(case_filters or {})}


def code_version(folder: str = ".") -> dict[str, object]:
    """Commit and whether the tree has changes, or nothing outside of a repository."""
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    head = run("rev-parse", "HEAD")
    return {"commit": head.stdout.strip(), "dirty": bool(run("status", "--porcelain").stdout.strip())} if head.returncode == 0 else {}


def settings(p: Profile) -> dict[str, object]:
    return asdict(p)
