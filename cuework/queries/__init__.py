"""All registered queries."""

from cuework.queries import catalogue, flows, tables, texts, timing  # noqa: F401
from cuework.queries.registry import QUERIES, SQL  # noqa: F401
