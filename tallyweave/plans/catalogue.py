"""Every registered query outside the training-data operators, and its SQL."""

from __future__ import annotations

from . import blocks, evidences, facts, pools, returns, texts
from .registry import QUERIES, SQL, Query

FLAGSHIP: Query = facts.shared_topn_residual
__all__ = ["FLAGSHIP", "blocks", "evidences", "facts", "oracle_sql", "pools", "queries", "returns", "texts"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
