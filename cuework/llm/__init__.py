"""Operations of a training-data pipeline."""

from cuework.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
