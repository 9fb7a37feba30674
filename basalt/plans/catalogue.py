"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from . import conversation, corpus, derived, evaluation, landed, operations, pages, relational, retrieval, state  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
