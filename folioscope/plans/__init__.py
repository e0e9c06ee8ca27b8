"""Registered queries over the given tables, by area."""

from importlib import import_module

_AREAS = ("document", "trace", "library", "retrieval", "citation", "web", "transcript", "name",
          "account", "source", "stream")


def load() -> None:
    """Register every query."""
    for area in _AREAS:
        import_module(f"{__name__}.{area}_queries")
