"""Queries of the library over the test tables."""

from __future__ import annotations

import importlib

from riskloom.plans.registry import CASES, Case

MODULES = (
    "scalars",
    "loans",
    "accounts",
    "evaluation",
    "drifts",
    "pricing",
    "quality",
    "models",
    "trends",
    "texts",
    "io",
)


def all_cases() -> dict[str, Case]:
    for m in MODULES:
        importlib.import_module(f"riskloom.plans.{m}")
    return dict(CASES)
