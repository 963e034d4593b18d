"""Queries on the driver's tables, one per operator, each with its SQL twin."""

from __future__ import annotations

from . import base


def load() -> dict[str, base.Query]:
    from . import (  # noqa: F401
        cohort, counts, discover, diseases, evaluate, exprs, hygiene, learn, occurrence, patterns, plans, sequence, storage, text,
        values,
    )

    return base.REGISTRY
