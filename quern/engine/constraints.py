"""Constraints, checked on whole sets of rows before a commit.

A check is a frame that has a row if the constraint fails, and the error for that; ``settle`` asks all of a
statement's checks in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Stats, Table
from .errors import CONSTRAINT_VIOLATION, PROTOCOL, EngineError
from .lexer import quote
from .parser import Constraint

#: Rows of some files of a table, by name; all files if none are named.
Rows = Callable[..., DataFrame]
Check = tuple[DataFrame, EngineError]


def settle(checks: list[Check]) -> None:
    """Raise the error of the first check that fails."""
    if not checks:
        return
    asked = [frame.limit(1).select(F.lit(i).alias("i")) for i, (frame, _) in enumerate(checks)]
    failed = reduce(DataFrame.union, asked).collect()  # a row a check
    if failed:
        raise checks[min(r["i"] for r in failed)][1]


def _full(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys without a null: others match nothing."""
    return df.select(*[quote(c) for c in columns]).dropna()


def row_rules(table: Table) -> dict[str, tuple[Column, EngineError]]:
    """Conditions that no row may meet: NOT NULL, and CHECK, which fails only where it is false."""
    rules = {f"null {c}": (F.col(quote(c)).isNull(), EngineError(PROTOCOL, f"null in {table.name}.{c}")) for c in table.not_null}
    for k in table.constraints:
        if k.kind == "check":
            rules[f"check {k.name}"] = (F.expr(f"NOT coalesce({k.check}, true)"), EngineError(PROTOCOL, f"check {k.name} of {table.name} fails"))
        if k.kind == "primary":
            rules[f"key {k.name}"] = (F.expr(" OR ".join(f"{quote(c)} IS NULL" for c in k.columns)), EngineError(CONSTRAINT_VIOLATION, f"null in the primary key of {table.name}"))
    return rules


def row_checks(table: Table, rows: DataFrame) -> list[Check]:
    return [(rows.where(bad), error) for bad, error in row_rules(table).values()]


def _reach(table: Table, column: str, files: dict[str, Stats], of: str) -> dict[str, Stats]:
    """The table's files that may hold a value of ``column`` which is one of column ``of`` of ``files``."""
    if not all(of in s.low for s in files.values()):
        return table.files
    low, high = ([s.low[of] for s in files.values() if s.low[of] is not None], [s.high[of] for s in files.values() if s.high[of] is not None])
    return table.near(column, min(low), max(high)) if low else {}


def _all_reach(table: Table, files: dict[str, Stats], new: dict[str, Stats], columns: Iterable[tuple[str, str]]) -> dict[str, Stats]:
    for column, of in columns:
        near = _reach(table, column, new, of)
        files = {f: s for f, s in files.items() if f in near}
    return files


def key_checks(table: Table, new: dict[str, Stats], kept: dict[str, Stats], rows: Rows, columns: set[str] | None = None) -> list[Check]:
    """PRIMARY KEY and UNIQUE among the rows of new files, and of these against the files that are kept.
    ``columns`` names those that changed; other keys need no look."""
    out: list[Check] = []
    for k in table.constraints:
        if k.kind not in ("primary", "unique") or not new or (columns is not None and not columns & set(k.columns)):
            continue
        keys = _full(rows(table.name, new), k.columns)
        twice = keys.groupBy(*[quote(c) for c in k.columns]).agg(F.count("*").alias("_n")).where("_n > 1")
        error = EngineError(CONSTRAINT_VIOLATION, f"{k.name} of {table.name}: a key repeats")
        out.append((twice, error))
        near = _all_reach(table, kept, new, zip(k.columns, k.columns, strict=True))
        if near:
            out.append((_full(rows(table.name, near), k.columns).join(keys, k.columns, "left_semi"), error))
    return out


def parent_columns(k: Constraint, parent: Table) -> list[str]:
    """The referenced columns: those named, or else the parent's primary key."""
    if k.parent_columns:
        return k.parent_columns
    for p in parent.constraints:
        if p.kind == "primary":
            return p.columns
    raise EngineError(CONSTRAINT_VIOLATION, f"{parent.name} has no primary key")


def _keys_of(k: Constraint, parent: Table, rows: DataFrame) -> DataFrame:
    """The referenced columns of a parent's rows, under the names of the child's."""
    return rows.select(*[F.col(quote(p)).alias(c) for p, c in zip(parent_columns(k, parent), k.columns, strict=True)])


def parent_checks(table: Table, new: dict[str, Stats], tables: dict[str, Table], rows: Rows, columns: set[str] | None = None) -> list[Check]:
    """FOREIGN KEY of the rows of new files; a key with a null refers to nothing."""
    out: list[Check] = []
    for k in table.constraints:
        if k.kind != "foreign" or not new or (columns is not None and not columns & set(k.columns)):
            continue
        parent = tables.get(k.parent)
        if parent is None:
            raise EngineError(CONSTRAINT_VIOLATION, f"{k.name} of {table.name}: no table {k.parent}")
        near = _all_reach(parent, parent.files, new, zip(parent_columns(k, parent), k.columns, strict=True))
        there = _keys_of(k, parent, rows(parent.name, near))
        out.append((_full(rows(table.name, new), k.columns).join(there, k.columns, "left_anti"), EngineError(CONSTRAINT_VIOLATION, f"{k.name} of {table.name}: a row has no parent in {parent.name}")))
    return out


def child_checks(table: Table, gone: DataFrame, tables: dict[str, Table], rows: Rows, columns: set[str] | None = None) -> list[Check]:
    """No row that refers to the table may lose its parent. ``gone`` has the rows of the table that were
    deleted or changed, as they were."""
    out: list[Check] = []
    for child in tables.values():
        for k in child.constraints:
            if k.kind == "foreign" and k.parent == table.name and (columns is None or columns & set(parent_columns(k, table))):
                there = rows(child.name)  # the change depends on it even while it is empty
                if not child.files:
                    continue
                lost = _keys_of(k, table, gone).dropna().distinct().join(_keys_of(k, table, rows(table.name)), k.columns, "left_anti")
                out.append((_full(there, k.columns).join(lost, k.columns, "left_semi"), EngineError(CONSTRAINT_VIOLATION, f"rows of {child.name} refer to rows of {table.name}")))
    return out
