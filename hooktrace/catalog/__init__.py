"""All named queries, registered on import."""

from hooktrace.catalog import columns, filters, joins, reports, scoring, streams, writes  # noqa: F401
from hooktrace.catalog.registry import ORACLES, QUERIES  # noqa: F401
