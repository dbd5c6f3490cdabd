"""All registered queries and their SQL."""

from seriesmend.workload import (  # noqa: F401  (importing registers the queries)
    corrections,
    detection,
    exports_and_views,
    history,
    sessions,
    sources_and_selection,
)
from seriesmend.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
