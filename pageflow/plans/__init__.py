"""Query plans."""

from . import catalogue, measures, more, runs  # noqa: F401  registers the queries
