"""Registered queries: every operator bound to the benchmark tables, with DuckDB counterparts."""

from importlib import import_module

MODULES = ("tables_io", "searching", "matching", "aggregates", "cleaning", "ranking", "audits", "training", "webpages", "streams")


def load() -> None:
    for m in MODULES:
        import_module(f"offerloom.plans.{m}")
