"""Stand-ins for models, to try commands and queries where there are none. What they give is not comparable with a model's."""

from __future__ import annotations

import json
import re
import zlib

from tessera.functions.text import bigrams_py


def embed(texts: list[str]) -> list[list[float]]:
    """Counts of character bigrams by hash."""
    out = []
    for t in texts:
        v = [0.01] * 64
        for g in bigrams_py(t):
            v[zlib.crc32(g.encode()) % 64] += 1.0
        out.append(v)
    return out


def generate(prompts: list[str]) -> list[tuple[str, bool]]:
    """The first line of the first source, with its citation."""
    out = []
    for p in prompts:
        sources = json.loads(p[p.index("\n[") + 1 :])
        out.append((f"{sources[0]['text'].strip().splitlines()[0]} [1]" if sources else "", False))
    return out


def judge(prompts: list[str]) -> list[str]:
    """Correct if the answer's first word stands in the reference."""
    out = []
    for p in prompts:
        reference, answer = re.search(r"\[참고 근거\]\n(.*)\n\n\[답변\]\n(.*)", p, re.S).groups()
        word = (answer.split() or [""])[0]
        out.append(json.dumps({"verdict": "correct" if word and word in reference else "incorrect"}))
    return out
