"""How models are shown: one line by ``repr``, all parameters by ``describe``."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

import numpy as np

#: Arrays with a longer side, and lists of more parts, are shortened unless a full description is asked for.
LIMIT = 4


def _value(v, full: bool) -> str:
    if isinstance(v, np.ndarray):
        if full or max(v.shape, default=0) <= LIMIT:
            return np.array2string(v, precision=6 if full else 4, separator=", ", threshold=v.size + 1, max_line_width=10**6).replace("\n", "")
        return "array of " + " x ".join(map(str, v.shape))
    return f"{v:.6g}" if isinstance(v, float) else repr(v)


def _lines(name: str, v, full: bool, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(v, Described):
        return [f"{pad}{name}: {type(v).__name__}", *_parts(v, full, depth + 1)]
    if isinstance(v, tuple) and v and all(isinstance(x, Described) for x in v):
        shown = v if full or len(v) <= LIMIT else v[: LIMIT - 1]
        out = [line for i, x in enumerate(shown) for line in _lines(f"{name}[{i + 1}]", x, full, depth)]
        return out + ([f"{pad}... and {len(v) - len(shown)} more"] if len(shown) < len(v) else [])
    return [f"{pad}{name}: {_value(v, full)}"]


def _parts(model, full: bool, depth: int) -> list[str]:
    return [line for f in fields(model) if getattr(model, f.name) is not None for line in _lines(f.name, getattr(model, f.name), full, depth)]


class Described:
    """Base of the models' dataclasses, which declare ``repr=False``."""

    def describe(self, full: bool = False) -> str:
        """A line for each parameter, and those of parts below them; ``full`` shortens nothing."""
        return "\n".join([type(self).__name__, *_parts(self, full, 1)])

    def __repr__(self) -> str:
        if not is_dataclass(self):
            return object.__repr__(self)
        shown = ", ".join(f"{f.name}={_value(getattr(self, f.name), False)}" for f in fields(self) if getattr(self, f.name) is not None)
        return f"{type(self).__name__}({shown})"
