"""What the store raises."""

from __future__ import annotations


class StoreError(Exception):
    """All errors of the store."""


class InvalidFilter(StoreError, ValueError):
    """A filter with an unknown operation or without what it needs."""


class InvalidInput(StoreError, ValueError):
    """A table without a column that a call needs, or an argument out of range."""


class NotConfigured(StoreError, RuntimeError):
    """A call that needs a function which the store wasn't given."""


def need(df, *columns: str) -> None:
    """Raises where ``df`` lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidInput(f"the table has no column {', '.join(missing)}")
