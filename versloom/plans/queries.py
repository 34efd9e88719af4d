"""All queries over the test tables by name."""

from versloom.plans import join_queries, more_queries, segment_queries, stream_queries, study_queries, text_queries  # noqa: F401
from versloom.plans.registry import QUERIES  # noqa: F401
