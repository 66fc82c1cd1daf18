"""Loads every job module and exposes the registered jobs."""

from dwellkit.plans import (  # noqa: F401
    aggregate_jobs,
    invariant_jobs,
    join_jobs,
    label_jobs,
    metric_jobs,
    model_jobs,
    quality_jobs,
    resample_jobs,
    scalar_jobs,
    source_jobs,
    survival_jobs,
    window_jobs,
)
from dwellkit.plans.registry import QUERIES, SQL  # noqa: F401
