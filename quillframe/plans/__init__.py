"""Ready-made queries over the star-schema, event and text tables."""

from importlib import import_module

MODULES = ("extraction", "documents", "contracts", "sinks", "questions", "datasets", "relational", "large_sources")


def load_all() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
