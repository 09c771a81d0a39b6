"""All queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from fundspark.llm import queries_native, queries_text

QUERIES = {**queries_native.QUERIES, **queries_text.QUERIES}
ORACLE = {**queries_native.ORACLE, **queries_text.ORACLE}
