"""The named queries, each with the SQL that gives the same rows."""

from tidelog.plans import clusters, logs, sessions, sources, state  # noqa: F401  (they enter their queries)
from tidelog.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
