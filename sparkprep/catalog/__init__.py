"""Example queries, one per operator, over the shared test tables, with an equal SQL statement where one exists."""

from importlib import import_module

GROUPS = (
    "source_queries",
    "profile_queries",
    "treatment_queries",
    "encoding_queries",
    "transform_queries",
    "plan_queries",
    "feature_queries",
    "model_queries",
    "text_queries",
    "stream_queries",
)


def load() -> tuple[dict, dict]:
    """({name: function of (spark, folder)}, {name: SQL})."""
    from . import registry

    for g in GROUPS:
        import_module(f"{__name__}.{g}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
