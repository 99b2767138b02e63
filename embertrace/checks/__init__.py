"""Registered queries and, beside each, SQL that another engine answers over the same tables."""


def load():
    """(queries, oracle SQL), with every module that registers some imported."""
    from embertrace.checks import (  # noqa: F401
        detection, enrichment, feature_checks, model_checks, outcome_checks, registry, search_checks, summaries, varied_checks)

    return registry.QUERIES, registry.ORACLES
