"""Named queries over the test tables and their SQL twins."""

from demandloom.plans import (  # noqa: F401
    aggregate_queries,
    attribution_queries,
    cleaning_queries,
    dashboard_queries,
    evaluation_queries,
    feature_queries,
    forecast_queries,
    join_queries,
    scalar_queries,
    scoring_queries,
    screening_queries,
    set_queries,
    source_queries,
    window_queries,
)
from demandloom.plans.registry import registered, registered_sql

__all__ = ["registered", "registered_sql"]
