"""Joins. Catalyst picks the strategy by statistics and AQE corrects it while running; hints are for
measuring and for cases it can't know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}
#: The sides that a kind of join can broadcast.
SIDES = {"inner": (0, 1), "left": (1,), "right": (0,), "semi": (1,), "anti": (1,), "cross": (0, 1)}
#: A side is broadcast up to so many rows and, by Catalyst's statistics, bytes: it passes through the driver's memory.
ROWS, BYTES = 1 << 18, 8 << 20


def join(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str] | None = None, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """``on``: a condition, or columns that both have (USING). ``how``: inner, left, right, full, cross,
    semi or anti. A broadcast takes the smaller side that ``how`` allows; where that is too large (ROWS, BYTES),
    Catalyst picks the strategy."""
    if strategy == "broadcast":
        left, right = _broadcast(left, right, SIDES.get(how, ()))
    elif strategy is not None:
        right = right.hint(STRATEGIES[strategy])
    if how == "cross":
        return left.crossJoin(right)
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    return left.join(right, list(on) if isinstance(on, (list, tuple)) else on, kind)


def _broadcast(left: DataFrame, right: DataFrame, sides: Sequence[int]) -> list[DataFrame]:
    """Both, with a hint at the smaller of the sides if it is small enough. Statistics are about the bytes of files,
    which may hold many more rows than bytes suggest, so rows are counted too, as far as ROWS."""
    both = [left, right]
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bytes_of = {i: size(both[i]) for i in sides}
    if bytes_of:
        i = min(sides, key=bytes_of.__getitem__)
        if bytes_of[i] <= BYTES and both[i].limit(ROWS + 1).count() <= ROWS:
            both[i] = both[i].hint(STRATEGIES["broadcast"])
    return both


def exists(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str]) -> DataFrame:
    return join(left, right, on, "semi")


def not_exists(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str]) -> DataFrame:
    return join(left, right, on, "anti")


def if_any(left: DataFrame, right: DataFrame) -> DataFrame:
    """All of ``left`` if ``right`` has a row: an uncorrelated EXISTS. One row at most is broadcast."""
    from pyspark.sql import functions as F

    return left.join(F.broadcast(right.select(F.lit(1).alias("_any")).limit(1)), how="left_semi")
