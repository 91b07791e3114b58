"""Queries that apply the operators to their whole tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")


def _modules():
    return [import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
