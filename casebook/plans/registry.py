"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from casebook.plans.standin import CHANGED, CODES, OLD_CODES, RAW, RECORDS, VIEW

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_WITH = f"WITH incidents AS ({VIEW}),\nraw AS ({RAW}),\ncodes AS ({CODES}),\nold_codes AS ({OLD_CODES}),\nchanged AS ({CHANGED}),\nrecords AS ({RECORDS})\n"


def query(sql: str | None = None):
    """Registers a function under its name. sql: a SELECT, or `, name AS (...) SELECT`, over
    incidents, raw, codes, old_codes, changed and records."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = _WITH + sql
        return function

    return add
