"""Evidence-grounded text analytics as Spark jobs over tables of documents, queries,
responses, turns and events."""

from .session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
