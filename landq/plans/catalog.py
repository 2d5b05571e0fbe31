"""All registered queries, by section."""

from __future__ import annotations

import importlib

from landq.plans.suite import Suite

SECTIONS = ["tables", "filters", "joins", "rules", "duplicates", "crossdoc", "text", "extraction", "confidence", "reports", "accuracy",
            "workflow", "geometry", "streams"]


def load() -> list[Suite]:
    return [importlib.import_module(f"landq.plans.{name}").suite for name in SECTIONS]


def queries() -> dict:
    return {name: call for suite in load() for name, call in suite.callables().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for suite in load() for name, sql in suite.sql.items()}
