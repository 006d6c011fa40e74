"""All registered queries; importing the modules registers them."""

from labspark.plans import (
    queries_models,
    queries_predict,
    queries_quality,
    queries_reports,
    queries_resample,
    queries_reshape,
    queries_runs,
    queries_stored,
    queries_tables,
    queries_text,
)
from labspark.plans.registered import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "queries_models",
    "queries_predict",
    "queries_quality",
    "queries_reports",
    "queries_resample",
    "queries_reshape",
    "queries_runs",
    "queries_stored",
    "queries_tables",
    "queries_text",
]
