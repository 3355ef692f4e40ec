"""Sessions: one statement at a time, on tables that a session sees as of its transaction's start.

Queries go to Spark with the tables as views. A change writes new files for the rows it touches, file by
file: files without a matching row stay as they are, so a point update of a large table rewrites only
what holds its rows. Constraints are checked on the outcome before anything is published.
"""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructField, StructType

from . import ddl
from .access import Access
from .catalog import Catalog, Stats, Table
from .constraints import Rows, child_checks, key_checks, parent_checks, row_rules, settle
from .errors import (
    ALREADY_IN_TRANSACTION, DDL_IN_TRANSACTION, INTERNAL, NO_ACTIVE_TRANSACTION, PROTOCOL, QUERY_TIMEOUT, RESULT_ROWS_TOO_LARGE, SQL_TOO_LONG, UNSUPPORTED_SQL, EngineError,
)
from .lexer import Token, quote, render, statements, tokens
from .parser import DDL, DML, Parser, Statement

_TRIES = 5
#: Rows that are rewritten together as one file, without a look which of their files are concerned, and how
#: many small files an INSERT leaves beside each other.
SMALL, FEW = 100_000, 16


@dataclass
class Policy:
    """Limits of one statement; None: no limit."""

    sql_bytes: int | None = 1 << 20
    rows: int | None = None
    seconds: float | None = None

    @classmethod
    def interactive(cls) -> Policy:
        """For people at a prompt: 65,536 rows and 30 seconds."""
        return cls(rows=65_536, seconds=30.0)


@dataclass
class Result:
    """A query's rows as a DataFrame, or how many rows a change affected."""

    frame: DataFrame | None = None
    rows_affected: int = 0

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []

    @property
    def columns(self) -> list[str]:
        return self.frame.columns if self.frame is not None else []


class Engine:
    """Tables in a folder. Sessions of one engine, or of several on the same folder, see each other's
    commits."""

    def __init__(self, spark: SparkSession, data_dir: str, policy: Policy | None = None, access: Access | None = None, serializable: bool = False):
        """With ``serializable`` a transaction also fails if a table that its statements read has changed;
        else it reads a snapshot, and fails if one that it changed, or was checked against, has."""
        self.spark, self.catalog, self.serializable = spark, Catalog(spark, data_dir), serializable
        self.policy, self.access = policy or Policy(), access

    def connect(self, user: str | None = None) -> Session:
        return Session(self, user)

    def table(self, name: str) -> DataFrame:
        """A table's committed rows."""
        found = self.catalog.load()[1]
        if name.lower() not in found:
            raise EngineError(PROTOCOL, f"no table {name}")
        return self.catalog.read(found[name.lower()])


class Transaction:
    """``with session.begin():`` commits at the end, and rolls back on an error."""

    def __init__(self, session: Session):
        self.session = session

    def __enter__(self) -> Session:
        return self.session

    def __exit__(self, kind, _error, _trace) -> None:
        if self.session.in_transaction:
            self.session.execute("COMMIT" if kind is None else "ROLLBACK")


class Session:
    def __init__(self, engine: Engine, user: str | None = None):
        self.engine, self.user, self.catalog = engine, user, engine.catalog
        self.spark = engine.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.session.timeZone"):
            self.spark.conf.set(key, engine.spark.conf.get(key))
        self.in_transaction = False
        self.base: dict[str, Table] = {}
        self.staged: dict[str, Table | None] = {}
        self.depends: set[str] = set()
        self.prepared: dict[str, list[Token]] = {}
        self.viewed: set[str] = set()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_error) -> None:
        self.close()

    def close(self) -> None:
        """An open transaction is rolled back."""
        self.in_transaction, self.staged = False, {}

    def begin(self) -> Transaction:
        self.execute("BEGIN TRANSACTION")
        return Transaction(self)

    # -- entry points
    def execute(self, sql: str) -> Result:
        """One statement; a closing semicolon is allowed."""
        if self.engine.policy.sql_bytes is not None and len(sql.encode()) > self.engine.policy.sql_bytes:
            raise EngineError(SQL_TOO_LONG, "the SQL text is too long")
        found = statements(sql)
        if len(found) != 1:
            raise EngineError(PROTOCOL, f"one statement is wanted, {len(found)} were given")
        return self._limited(lambda: self._run(found[0]))

    def execute_script(self, sql: str | list[str]) -> Result:
        """Statements in turn, in this session; the rows affected add up and the last frame is kept."""
        total = Result()
        for s in [render(x) for x in statements(sql)] if isinstance(sql, str) else sql:
            r = self.execute(s)
            total = Result(r.frame if r.frame is not None else total.frame, total.rows_affected + r.rows_affected)
        return total

    def _limited(self, run) -> Result:
        policy = self.engine.policy
        try:
            if policy.seconds is None:
                return self._capped(run(), policy)
            sc, tag = self.spark.sparkContext, f"quern-{id(self)}-{time.monotonic_ns()}"
            late, over = threading.Event(), threading.Event()

            def watch() -> None:
                wait = policy.seconds
                while not over.wait(wait):  # again and again: a job may start after the first call
                    late.set()
                    sc.cancelJobsWithTag(tag)
                    wait = 0.2

            sc.addJobTag(tag)
            threading.Thread(target=watch, daemon=True).start()
            try:
                result = run()
                if result.frame is not None:  # its time counts
                    result = Result(self.spark.createDataFrame(self._capped(result, policy).frame.collect(), result.frame.schema))
                return result
            except Exception as e:
                if late.is_set():
                    raise EngineError(QUERY_TIMEOUT, f"no result within {policy.seconds:g} s") from e
                raise
            finally:
                over.set()
                sc.removeJobTag(tag)
        except EngineError:
            raise
        except PySparkException as e:
            raise EngineError(PROTOCOL if e.getCondition() else INTERNAL, str(e).splitlines()[0]) from e

    def _capped(self, result: Result, policy: Policy) -> Result:
        if policy.rows is not None and result.frame is not None and len(result.frame.limit(policy.rows + 1).select(F.lit(1)).collect()) > policy.rows:
            raise EngineError(RESULT_ROWS_TOO_LARGE, f"more than {policy.rows} rows")
        return result

    def _run(self, parts: list[Token]) -> Result:
        s = Parser(parts).statement()
        if self.engine.access:
            self.engine.access.check(self.user, s)
        if s.kind in DDL and self.in_transaction:
            raise EngineError(DDL_IN_TRANSACTION, "no change of schema within a transaction")
        if s.kind in DML | DDL:
            return self._change(s)
        return getattr(self, f"_{s.kind}")(s)

    # -- transactions
    def _begin(self, _s: Statement) -> Result:
        if self.in_transaction:
            raise EngineError(ALREADY_IN_TRANSACTION, "a transaction is open")
        self.base, self.staged, self.depends, self.in_transaction = self.catalog.load()[1], {}, set(), True
        return Result()

    def _commit(self, _s: Statement) -> Result:
        self._end()
        staged, self.staged = self.staged, {}
        if staged and not self.catalog.commit(self.base, staged, self.depends):
            raise EngineError(INTERNAL, "another session has changed a table of this transaction; it is rolled back")
        return Result()

    def _rollback(self, _s: Statement) -> Result:
        self._end()
        self.staged = {}
        return Result()

    def _end(self) -> None:
        if not self.in_transaction:
            raise EngineError(NO_ACTIVE_TRANSACTION, "no transaction is open")
        self.in_transaction = False

    def tables(self) -> dict[str, Table]:
        """The tables as this session sees them."""
        if not self.in_transaction:
            self.base, self.staged, self.depends = self.catalog.load()[1], {}, set()
        return {k: t for k, t in (self.base | self.staged).items() if t is not None}

    def _change(self, s: Statement) -> Result:
        """DML or DDL: at once in a transaction; else committed, and tried again if others were faster."""
        for left in range(_TRIES, 0, -1):
            tables = self.tables()
            changed, affected = (getattr(self, f"_{s.kind}") if s.kind in DML else lambda s, t: (ddl.run(self, s, t), 0))(s, tables)
            if self.in_transaction:
                self.staged |= changed
                return Result(rows_affected=affected)
            if not changed or self.catalog.commit(self.base, changed, self.depends):
                return Result(rows_affected=affected)
            if left == 1:
                raise EngineError(INTERNAL, "other sessions keep changing the table")
        raise AssertionError

    # -- queries
    def rows(self, table: Table, files: dict[str, Stats] | None = None) -> DataFrame:
        return Catalog.read(self._reader(), table, files)

    def _reader(self) -> Catalog:
        out = Catalog.__new__(Catalog)
        out.spark, out.files = self.spark, self.catalog.files
        return out

    def viewer(self, tables: dict[str, Table]) -> Rows:
        """Rows by name for the checks; the commit depends on the tables that they look at."""

        def rows(name: str, files: dict[str, Stats] | None = None) -> DataFrame:
            self.depends.add(name)
            return self.rows(tables[name], files)

        return rows

    def frame(self, parts: list[Token]) -> DataFrame:
        """A query over the session's tables; those it names are made views."""
        self._views(parts, self.tables())
        return self.spark.sql(render(parts))

    def _query(self, s: Statement) -> Result:
        return Result(self.frame(s.body))

    def _explain(self, s: Statement) -> Result:
        """One column, QUERY PLAN. With ANALYZE the statement runs and its time and rows follow."""
        inner = Parser(s.body).statement()
        if inner.kind == "query":
            plan = self._plan(s.body, s.other)
        else:
            table = self._known(self.tables(), inner.table, inner.kind == "insert")
            source = inner.body if inner.kind == "insert" else tokens(f"SELECT * FROM {quote(table.name if table else inner.table)}" + (f" WHERE {inner.where}" if inner.where else ""))
            plan = [f"{inner.kind.capitalize()} on {inner.table}"]
            plan += [f"  {x}" for x in self._plan(source, s.other)] if source else [f"  Values: {len(inner.rows)} rows"]
        if s.flag:
            began = time.perf_counter()
            result = self._run(s.body)
            n = result.frame.count() if result.frame is not None else result.rows_affected
            plan += [f"Execution Time: {(time.perf_counter() - began) * 1000:.3f} ms", f"{'Rows' if result.frame is not None else 'Rows Affected'}: {n}"]
        return Result(self.spark.createDataFrame([(x,) for x in plan], "`QUERY PLAN` string"))

    def _plan(self, parts: list[Token], verbose: bool) -> list[str]:
        self.frame(parts)
        text = self.spark.sql(f"EXPLAIN {'EXTENDED' if verbose else 'FORMATTED'} {render(parts)}").first()[0]
        return [x for x in text.splitlines() if x.strip()]

    def _prepare(self, s: Statement) -> Result:
        if s.body and s.body[0].upper() in ("PREPARE", "EXECUTE", "BEGIN", "COMMIT", "ROLLBACK"):
            raise EngineError(UNSUPPORTED_SQL, "such statements aren't prepared")
        Parser([t if t.kind != "param" else Token("number", "0", t.start, t.end) for t in s.body]).statement()
        self.prepared[s.name.lower()] = s.body
        return Result()

    def _execute(self, s: Statement) -> Result:
        """Parameters are ? in turn, or $1, $2 and so on; values are constants."""
        if s.name.lower() not in self.prepared:
            raise EngineError(PROTOCOL, f"nothing is prepared as {s.name}")
        values, parts, nth, used = s.rows[0] if s.rows else [], [], 0, set()
        for t in self.prepared[s.name.lower()]:
            if t.kind == "param":
                at = nth if t.text == "?" else int(t.text[1:]) - 1 if t.text[0] == "$" else -1
                nth += t.text == "?"
                if not 0 <= at < len(values):
                    raise EngineError(PROTOCOL, f"no value for parameter {t.text}")
                used.add(at)
                t = Token("value", f"({values[at]})", t.start, t.end)
            parts.append(t)
        if len(used) != len(values):
            raise EngineError(PROTOCOL, f"{len(values)} values for {len(used)} parameters")
        return self._run(parts)

    # -- changes of rows
    def _known(self, tables: dict[str, Table], name: str, missing: bool = False) -> Table | None:
        if name.lower() not in tables and not missing:
            raise EngineError(PROTOCOL, f"no table {name}")
        return tables.get(name.lower())

    def _insert(self, s: Statement, tables: dict[str, Table]) -> tuple[dict[str, Table | None], int]:
        table = self._known(tables, s.table, missing=True)
        new = self._source(s, table)
        if table is None or (table.dynamic and set(new.columns) - set(table.columns)):
            table = self._grown(table, s.table, new)
        struct = table.struct
        given = {table.column(c): c for c in new.columns}
        columns = []
        for f in struct.fields:
            value = F.col(quote(given[f.name])) if f.name in given else F.expr(table.defaults.get(f.name, "NULL"))
            columns.append(value.cast(f.dataType).alias(f.name))
        few = [f for f, x in table.files.items() if x.rows < SMALL // FEW]
        small = bool(s.rows) and len(s.rows) < SMALL
        merged = {f: table.files[f] for f in few} if small and len(few) >= FEW else {}
        files, _ = self._written(table, new.select(*columns), small)
        kept = {f: x for f, x in table.files.items() if f not in merged}
        out = table.copy(files=table.files | files)
        after = tables | {out.name: out}
        view = self.viewer(after)
        settle(key_checks(out, files, table.files, view) + parent_checks(out, files, after, view))
        n = sum(x.rows for x in files.values())
        if merged and sum(x.rows for x in merged.values()) < SMALL:  # small files become one
            files = self.catalog.write(out, self.rows(out, merged | files), True)[0]
            out = out.copy(files=kept | files)
        return {out.name: out}, n

    def _written(self, table: Table, rows: DataFrame, small: bool, hit: str | None = None) -> tuple[dict[str, Stats], int]:
        """New files of rows that meet the rules for rows, and for how many of them ``hit`` holds."""
        rules = row_rules(table)
        counts = {k: bad for k, (bad, _) in rules.items()} | ({"hit": F.col(hit)} if hit else {})
        files, found = self.catalog.write(table, rows, small, counts)
        for k, (_, error) in rules.items():
            if found[k]:
                self.catalog.forget(files)
                raise error
        return files, found.get("hit", 0)

    def _source(self, s: Statement, table: Table | None) -> DataFrame:
        """The rows to insert, under the names of their columns."""
        if s.rows:
            if len({len(r) for r in s.rows}) != 1:
                raise EngineError(PROTOCOL, "rows differ in their number of values")
            frame = self.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(r)})" for r in s.rows))
        else:
            frame = self.frame(s.body)
        names = s.columns or (table.columns if table is not None and not table.dynamic else [f"col{i + 1}" for i in range(len(frame.columns))] if s.rows else frame.columns)
        if len({n.lower() for n in names}) != len(names):
            raise EngineError(PROTOCOL, "a column is named twice")
        if not s.columns and table is not None and not table.dynamic and len(frame.columns) < len(names):
            raise EngineError(PROTOCOL, f"{len(frame.columns)} values for {len(names)} columns")
        if len(names) != len(frame.columns):
            raise EngineError(PROTOCOL, f"{len(frame.columns)} values for {len(names)} columns")
        return frame.toDF(*names)

    def _grown(self, table: Table | None, name: str, new: DataFrame) -> Table:
        """A table that has no declared schema takes the columns that come."""
        fields = list(table.struct.fields) if table is not None else []
        have = {f.name.lower() for f in fields}
        fields += [StructField(f.name, ddl.TEXT if isinstance(f.dataType, NullType) else f.dataType) for f in new.schema.fields if f.name.lower() not in have]
        schema = StructType([StructField(f.name, f.dataType, True) for f in fields]).json()
        return table.copy(schema=schema) if table is not None else Table(name.lower(), schema, dynamic=True)

    def _near(self, table: Table, s: Statement) -> dict[str, Stats]:
        """The files that may hold a row which meets the condition: those whose statistics allow it, by the
        comparisons of a column with a constant that the condition joins by AND."""
        files, parts = table.files, [[]]
        depth = 0
        for t in s.body:
            depth += (t.text == "(") - (t.text == ")")
            if t.upper() in ("OR", "BETWEEN", "CASE", "SELECT"):
                return files
            if t.upper() == "AND" and not depth:
                parts.append([])
            else:
                parts[-1].append(t)
        for p in parts:
            if len(p) != 3 or p[0].kind not in ("word", "quoted") or p[2].kind not in ("number", "string") or p[1].text not in ("=", "<", "<=", ">", ">="):
                continue
            name = {c.lower(): c for c in table.columns}.get(p[0].name().lower())
            text = p[2].text
            value = int(text) if text.isdigit() else text[1:-1] if text[0] == "'" and "'" not in text[1:-1] and "\\" not in text else None
            if name and value is not None:
                low, high = (None if "<" in p[1].text else value), (None if ">" in p[1].text else value)
                allowed = table.near(name, low, high)
                files = {f: x for f, x in files.items() if f in allowed}
        return files

    def _touched(self, table: Table, s: Statement) -> tuple[dict[str, Stats], bool]:
        """The files that a change rewrites, and whether they are few enough to become one: those with a
        row that matches, or all that may have one if there is little in them."""
        files = self._near(table, s)
        if sum(x.rows for x in files.values()) <= SMALL:
            return files, True
        if s.where and not self._nested(s):
            hit = self.rows(table, files).where(s.where).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"))
            names = {"/".join(r["f"].rsplit("/", 2)[-2:]) for r in hit.collect()}  # a row a file
            files = {f: x for f, x in files.items() if "/".join(f.rsplit("/", 2)[-2:]) in names}
        return files, sum(x.rows for x in files.values()) <= SMALL

    def _update(self, s: Statement, tables: dict[str, Table]) -> tuple[dict[str, Table | None], int]:
        table = self._known(tables, s.table)
        sets = {}
        for column, value in s.sets:
            if (c := table.column(column)) in sets:
                raise EngineError(PROTOCOL, f"{column} is set twice")
            sets[c] = value
        self._views(s.body + tokens(" ".join(v for _, v in s.sets)), tables)
        touched, small = self._touched(table, s)
        if not touched:
            return {}, 0
        marked = self.rows(table, touched).withColumn("_hit", F.expr(f"coalesce({s.where}, false)") if s.where else F.lit(True))
        values = [F.when(F.col("_hit"), F.expr(sets[f.name]).cast(f.dataType)).otherwise(F.col(quote(f.name))).alias(f.name) if f.name in sets else F.col(quote(f.name)) for f in table.struct.fields]
        files, n = self._written(table, marked.select(*values, "_hit"), small, "_hit")
        if not n:
            self.catalog.forget(files)
            return {}, 0
        kept = {f: x for f, x in table.files.items() if f not in touched}
        out = table.copy(files=kept | files)
        after = tables | {out.name: out}
        view, columns = self.viewer(after), set(sets)
        settle(key_checks(out, files, kept, view, columns) + parent_checks(out, files, after, view, columns) + child_checks(out, marked.where("_hit"), after, view, columns))
        return {out.name: out}, n

    def _delete(self, s: Statement, tables: dict[str, Table]) -> tuple[dict[str, Table | None], int]:
        table = self._known(tables, s.table)
        self._views(s.body, tables)
        touched, small = self._touched(table, s) if s.where else (table.files, True)
        if not touched:
            return {}, 0
        rest = self.rows(table, touched).where(f"NOT coalesce({s.where}, false)") if s.where else None
        files = self.catalog.write(table, rest, small)[0] if rest is not None else {}
        n = sum(x.rows for x in touched.values()) - sum(x.rows for x in files.values())
        if not n:
            self.catalog.forget(files)
            return {}, 0
        out = table.copy(files={f: x for f, x in table.files.items() if f not in touched} | files)
        after = tables | {out.name: out}
        gone = self.rows(table, touched)
        settle(child_checks(out, gone.where(s.where) if s.where else gone, after, self.viewer(after)))
        return {out.name: out}, n

    def _analyze(self, s: Statement) -> Result:
        """A row a column: rows, nulls, distinct values (estimated), the least and the greatest value."""
        table = self._known(self.tables(), s.table)
        kinds = [f.name for f in table.struct.fields]
        text = lambda f, c: f(quote(c)).cast("string")
        of = lambda c: F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(quote(c)).isNull()).alias("null_count"), F.approx_count_distinct(quote(c)).alias("distinct_count"), text(F.min, c).alias("low"), text(F.max, c).alias("high"))
        found = self.rows(table).agg(F.array(*[of(c) for c in kinds]).alias("c"))
        return Result(found.select(F.explode("c").alias("c")).select("c.*"))

    def _views(self, parts: list[Token], tables: dict[str, Table]) -> None:
        """Views of the tables that some SQL names; views of what is gone go too."""
        named = {t.name().lower() for t in parts if t.kind in ("word", "quoted")}
        for name in named & self.viewed - tables.keys():
            self.spark.catalog.dropTempView(name)
        for name in named & tables.keys():
            self.rows(tables[name]).createOrReplaceTempView(name)
        self.viewed |= named & tables.keys()
        if self.engine.serializable:
            self.depends |= named & tables.keys()

    @staticmethod
    def _nested(s: Statement) -> bool:
        return any(t.upper() == "SELECT" for t in s.body) or any(re.search(r"\bselect\b", v, re.I) for _, v in s.sets)
