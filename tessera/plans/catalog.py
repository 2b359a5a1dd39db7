"""All queries of the library but those of the subpackage for training data."""

from __future__ import annotations

from . import q_curate, q_io, q_labels, q_scoring, q_signal  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
