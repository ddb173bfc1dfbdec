"""All registered queries with their oracle SQL, where SQL can express them."""

from __future__ import annotations

from riskloom.catalog import models, streams, tabular, text, watch

MODULES = [tabular, watch, text, streams, models]


def entries() -> dict:
    out = {}
    for module in MODULES:
        out |= module.QUERIES
    return out
