"""Errors with stable numeric codes."""

from __future__ import annotations

#: The codes that clients map.
STUB, INTERNAL = 1000, 1001
PROTOCOL, SQL_TOO_LONG, QUERY_TIMEOUT, RESULT_ROWS_TOO_LARGE, UNSUPPORTED_SQL = 2000, 2001, 2002, 2003, 2004
CONSTRAINT_VIOLATION, NO_ACTIVE_TRANSACTION, ALREADY_IN_TRANSACTION, DDL_IN_TRANSACTION = 2005, 2006, 2007, 2008


class EngineError(Exception):
    """``code`` is one of the constants above."""

    def __init__(self, code: int, message: str):
        super().__init__(f"[{code}] {message}")
        self.code, self.message = code, message
