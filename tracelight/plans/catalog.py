"""All queries of the library, the training-data operators apart."""

from tracelight.plans import evidence_queries, key_queries, report_queries, scan_queries, text_queries  # noqa: F401
from tracelight.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
