"""All registered queries."""

from barweave.plans import evidence, rolling, samples, selection, tables, trading  # noqa: F401
from barweave.plans.registry import REGISTRY

QUERIES = REGISTRY
