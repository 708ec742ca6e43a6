"""All registered queries and their SQL twins, gathered from the topic modules."""

from __future__ import annotations

import importlib
import pkgutil

import qamill.plans as plans

TOPICS = sorted(
    m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("registry_")
)


def _gather(attribute: str) -> dict:
    out: dict = {}
    for topic in TOPICS:
        items = getattr(importlib.import_module(f"qamill.plans.{topic}"), attribute)
        twice = out.keys() & items.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out.update(items)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")
