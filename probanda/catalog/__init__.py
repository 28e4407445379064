"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from . import (  # noqa: F401
    assembly,
    comparison,
    ledger,
    retrieval,
    scans,
    streams,
    telemetry,
    text,
    validation,
    vectors,
)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
