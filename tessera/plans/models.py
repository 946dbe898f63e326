"""Models by name: module:attribute is loaded once in each Python process that uses it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

_LOADED: dict[tuple, Callable] = {}


@dataclass(frozen=True)
class Model:
    """A function of an installed module, or what its factory makes of the options; only the name travels to the executors.

    kind says what it is for. name is what an index records; another model must not ask questions of that index.
    """

    kind: str
    spec: str
    options: tuple[tuple[str, object], ...] = field(default=())

    @property
    def name(self) -> str:
        return dict(self.options).get("name", self.spec)

    def load(self) -> Callable:
        key = (self.kind, self.spec, self.options)
        if key not in _LOADED:
            module, sign, attribute = self.spec.partition(":")
            if not sign or not module or not attribute:
                raise ValueError(f"a {self.kind} model is named as module:function, not {self.spec!r}")
            try:
                found = getattr(importlib.import_module(module), attribute)
            except (ImportError, AttributeError) as e:
                raise ValueError(f"the {self.kind} model {self.spec} cannot be loaded: {e}") from e
            if not callable(found):
                raise ValueError(f"the {self.kind} model {self.spec} is no function")
            if attribute.startswith("load"):  # a factory
                found = found(**dict(self.options))
                if not callable(found):
                    raise ValueError(f"{self.spec} gave no function")
            _LOADED[key] = found
        return _LOADED[key]

    def __call__(self, *args, **more):
        return self.load()(*args, **more)


def parse(kind: str, spec: str | None) -> Model | None:
    """module:function, with options behind it as ,key=value."""
    if not spec:
        return None
    name, *pairs = spec.split(",")
    options = []
    for p in pairs:
        key, sign, value = p.partition("=")
        if not sign or not key:
            raise ValueError(f"an option of a model is key=value, not {p!r}")
        options.append((key, value))
    return Model(kind, name, tuple(options))


def local_generator(chat: Callable[[list[dict]], tuple[str, int, bool]], instructions: str, rules: str = "", limit: int = 1024) -> Callable[[list[str]], list[tuple[str, bool]]]:
    """A generator for pipeline.ask() around a model that runs here.

    chat takes messages and gives its text, how many tokens it made and whether the last one ended the text. An answer that
    used up limit without an end is cut off.
    """

    def generate(prompts: list[str]) -> list[tuple[str, bool]]:
        out = []
        for p in prompts:
            text, tokens, ended = chat([{"role": "system", "content": instructions + rules}, {"role": "user", "content": p}])
            out.append((text, tokens >= limit and not ended))
        return out

    return generate
