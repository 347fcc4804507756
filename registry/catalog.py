"""All registered queries."""

from registry import aggregates, importance, joins, quality, scans, series, streams, studies  # noqa: F401
from registry.base import QUERIES  # noqa: F401
