"""Runnable queries by name; importing the plan modules registers them."""


def catalogue():
    """All registered queries."""
    from barloom.plans import base, function_queries, model_queries, panel_queries, portfolio_queries, research_queries, risk_queries, signal_queries  # noqa: F401

    return base.REGISTRY
