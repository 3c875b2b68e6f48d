"""All registered queries."""

from __future__ import annotations

import importlib

from pubmeta.plans.base import QUERIES, Query

MODULES = (
    "text_queries",
    "ingest_queries",
    "biblio_queries",
    "tei_queries",
    "ocr_queries",
    "access_queries",
    "quality_queries",
    "event_queries",
)


def catalog() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"pubmeta.plans.{name}")
    return QUERIES
