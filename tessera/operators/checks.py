"""Checks over several sources: keys that only some have, and the columns to sort by."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessera.functions.categories import categories
from tessera.types import Annotated


def key_counts(parts: Sequence[Annotated]) -> dict[str, dict[str, int]]:
    """For each kind of key, in how many parts each key is found. Schemas only; no data is read."""
    out: dict[str, dict[str, int]] = {"layers": {}, "obsm": {}, "obs": {}}
    for p in parts:
        for c in p.rows.columns:
            kind = "layers" if c.startswith("layer_") else "obsm" if c.startswith("obsm_") else "obs" if c in p.obs_columns else None
            if kind:
                out[kind][c] = out[kind].get(c, 0) + 1
    return out


def warn_mismatch(parts: Sequence[Annotated]) -> dict[str, list[str]]:
    """Warns of keys that some parts lack; returns them by kind."""
    out = {}
    for kind, count in key_counts(parts).items():
        odd = sorted(k for k, n in count.items() if n < len(parts))
        if odd:
            out[kind] = odd
            warnings.warn(f"{kind}: {', '.join(odd)} not found in all sources; missing values are filled in", stacklevel=3)
    return out


def normalize_groupby(groupby: str | Sequence[str] | None) -> list[str]:
    if groupby is None:
        return []
    out = [groupby] if isinstance(groupby, str) else list(groupby)
    if not out:
        raise ValueError("groupby must name at least one column")
    if len(set(out)) != len(out):
        raise ValueError("groupby must not repeat a column")
    return out


def check_groupby(parts: Sequence[DataFrame], columns: Sequence[str]) -> None:
    """Each column must be in all parts, categorical in all or none, with equal categories in equal order."""
    for c in columns:
        there = [p for p in parts if c in p.columns]
        if not there:
            raise ValueError(f"groupby column {c!r} is missing from all sources")
        if len(there) < len(parts):
            raise ValueError(f"groupby column {c!r} is missing from {len(parts) - len(there)} of {len(parts)} sources")
        known = [categories(p, c) for p in parts]
        if any(k is None for k in known) != all(k is None for k in known):
            raise ValueError(f"groupby column {c!r} is categorical in some sources only")
        if any(k != known[0] for k in known):
            raise ValueError(f"groupby column {c!r} has different categories, or an order of them, between sources")
