"""All named queries of the core and their SQL."""

from __future__ import annotations

from quarrymill.plans import app, p_core, q_marts, q_raw, q_text

MODULES = [q_marts, q_raw, q_text, app, p_core]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
