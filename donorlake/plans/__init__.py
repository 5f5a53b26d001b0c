"""Composed analyses and the registry of queries over the driver tables."""


def all_queries():
    """The registry with every query module loaded."""
    from donorlake.plans import contract_queries, evaluation_queries, feature_queries, model_queries, quality_queries, registry  # noqa: F401

    return registry
