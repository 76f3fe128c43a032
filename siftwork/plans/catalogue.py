"""All bound queries.  Importing the modules registers them."""

from siftwork.plans import (  # noqa: F401
    corpus_queries,
    curation_queries,
    job_queries,
    text_queries,
    vector_queries,
)
from siftwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
