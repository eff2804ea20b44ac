"""Imports every query module so that the registry is complete."""

from churnlens.plans import q_decision, q_eval, q_model, q_policies, q_stream  # noqa: F401
from churnlens.plans.registry import ORACLE, QUERIES

# queries that fit models (rows-only checks; the slowest part of a run)
MODEL_QUERIES: set[str] = {name for name, fn in QUERIES.items() if fn.__module__.endswith("q_model")}

__all__ = ["QUERIES", "ORACLE", "MODEL_QUERIES"]
