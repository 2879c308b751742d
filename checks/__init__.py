from checks import (  # noqa: F401  (registration)
    asof, classify, dims, filters, ingest, merge, paging, secs, sinks, timeline, transfers, transitions, units,
)
from checks.registry import CHECKS

__all__ = ["CHECKS"]
