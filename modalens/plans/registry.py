"""All registered queries of the audit engine."""

from __future__ import annotations

from modalens.plans import align_profile, controls, evidence, landing, missing_batch, modelling, nesting, scores
from modalens.plans.missing_batch import flagship

__all__ = ["flagship", "oracle_sql", "queries"]
_ALL = {**missing_batch.QUERIES, **align_profile.QUERIES, **scores.QUERIES, **modelling.QUERIES, **landing.QUERIES, **evidence.QUERIES, **controls.QUERIES, **nesting.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
