"""All reference queries and their SQL."""

from __future__ import annotations

from importlib import import_module

from paddock.plans.base import QUERIES, SQL

for _part in ("statistics", "features", "browse", "identity", "sources_sql", "streams", "models", "repairs", "goldens", "planted", "assembly", "ingest"):
    import_module(f"paddock.plans.{_part}")


def queries() -> dict:
    return dict(QUERIES)


__all__ = ["SQL", "queries"]
