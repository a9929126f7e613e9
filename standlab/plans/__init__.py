"""Named queries over the sample tables, grouped by theme."""

from importlib import import_module

from standlab.plans.registry import REGISTRY, Query

_THEMES = ["relational", "stand", "terrain", "models", "compare"]


def all_queries() -> dict[str, Query]:
    for theme in _THEMES:
        import_module(f"standlab.plans.{theme}")
    return REGISTRY
