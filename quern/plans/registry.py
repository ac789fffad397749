"""All queries over the relational operators, and their SQL."""

from __future__ import annotations

from quern.plans import operator_queries, tpch

QUERIES = tpch.QUERIES | operator_queries.QUERIES
SQL = tpch.SQL | operator_queries.SQL
