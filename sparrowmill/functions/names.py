"""Column names that any model or file format takes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# What stands for a character in a name.
REPLACEMENTS = {"[": "_", "]": "_", "<": "_lt_", ">": "_gt_", " ": "_", "/": "_", "\\": "_", "(": "_", ")": "_", ",": "_", ":": "_", ";": "_", "-": "_"}
_TABLE = str.maketrans(REPLACEMENTS)


def safe_name(name: str) -> str:
    return re.sub("_{2,}", "_", name.translate(_TABLE)).strip("_") or "feature"


def safe_names(names: Iterable[str], safe: Callable[[str], str] = safe_name) -> dict[str, str]:
    """A distinct safe name for each name, in order; a taken one gets _1, _2 and so on."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in names:
        base = new = safe(str(name))
        k = 0
        while new in taken:
            k += 1
            new = f"{base}_{k}"
        taken.add(new)
        out[name] = new
    return out
