"""Imports every job module so that the registry is complete."""

from eventloom.plans import (  # noqa: F401
    catalog_jobs,
    crawl_jobs,
    health_jobs,
    listing_jobs,
    profile_jobs,
    scoring_jobs,
    stream_jobs,
    text_jobs,
    usage_jobs,
)
from eventloom.plans.jobs import CHECKS, QUERIES  # noqa: F401
