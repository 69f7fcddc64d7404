"""All queries of this subpackage and their SQL."""

from loamworks.llm import queries

QUERIES = {**queries.QUERIES}
SQL = {**queries.SQL}
