"""All registered queries, and the same as SQL."""

from vigil.plans import campaigns, contracts, evaluation, extended, knowledge, operations, streams, telemetry, variants, versions  # noqa: F401
from vigil.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
