"""How plan modules register a query together with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query under its function's name."""

        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return add


# SQL of expressions that several queries share, for DuckDB.

BARE = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '^\\s+|\\s+$', '', 'g'), '^https?://', '')"
NO_WWW = "regexp_replace({0}, '^www\\.', '')"
NORMALIZED_URL = "regexp_replace(regexp_replace(" + BARE + ", '^www\\.', ''), '/+$', '')"
HOST = "regexp_replace(regexp_replace(regexp_extract(" + BARE + ", '^[^/?#]*', 0), '^www\\.', ''), '\\.+$', '')"
PRESENT = "CASE WHEN lower(trim({0})) IN ('', 'none', 'null', 'nan', 'n/a', 'na', '-', '--', 'unknown', 'undefined') THEN NULL ELSE trim({0}) END"
_NUMBER = "regexp_extract(regexp_replace(" + PRESENT + ", '[\\s\\x{{A0}}\\x{{202F}}''’]', '', 'g'), '-?[0-9][0-9.,]*', 0)"
AMOUNT = (
    "try_cast(CASE WHEN regexp_matches(" + _NUMBER + ", '[.,][0-9]{{1,2}}$')"
    " THEN regexp_replace(regexp_extract(" + _NUMBER + ", '^(.*)[.,][0-9]{{1,2}}$', 1), '[.,]', '', 'g') || '.' || regexp_extract(" + _NUMBER + ", '([0-9]{{1,2}})$', 1)"
    " ELSE nullif(regexp_replace(" + _NUMBER + ", '[.,]', '', 'g'), '') END AS DOUBLE)"
)


def sql_of(template: str, column: str) -> str:
    """One of the shared expressions over a column."""
    return template.format(column)
