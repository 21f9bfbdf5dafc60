"""Registered queries (one per SURVEY §2 row) and the fixtures they read."""

from importlib import import_module

from .registry import ORACLE, QUERIES

_MODULES = ["q_profile", "q_shape", "q_eval", "q_ingest", "q_terms", "q_topics", "q_text", "q_stream", "q_models", "q_vectors",
            "q_neighbours", "q_words"]


def load_all() -> None:
    for m in _MODULES:
        import_module(f"{__name__}.{m}")


__all__ = ["ORACLE", "QUERIES", "load_all"]
