"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from eoframe.plans import catalog, contracts, generate, imagery, lifecycle, lineage, metadata, pixels, quality, requests  # noqa: F401
from eoframe.plans import roundtrips, sampling, scoring, streams  # noqa: F401
from eoframe.plans.registry import REGISTRY  # noqa: F401
