"""One query for each operator of the engine, over the driver's tables, with DuckDB SQL for the same rows.

Sums of money are made in decimals, so that they don't depend on the order of rows; orders and limits
name their null order and a unique last key.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import tpcc
from quern.engine.session import Engine, Session
from quern.functions import SCALAR, safe_divide
from quern.operators import aggregates as agg
from quern.operators import joins as jn
from quern.operators import relational as rel
from quern.sources.files import Tables, literals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def same_sql(name: str, sql: str, duck: str | None = None) -> None:
    """Register SQL that runs on both sides; tables stand in braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return spark.sql(sql, **{n: t.scan(n) for n in set(re.findall(r"\{(\w+)\}", sql))})

    _QUERIES[name] = run
    _SQL[name] = re.sub(r"\{(\w+)\}", r"\1", duck or sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- the flagship: filter, group, aggregate, order
@query("""SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(18,2))) AS DOUBLE) AS sum_disc_price, COUNT(*) AS count_order
  FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def pricing_summary(t: Tables) -> DataFrame:
    items = t.scan("lineitem", where="l_shipdate <= date'1998-09-02'")
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount")).cast("decimal(18,2)")
    out = agg.aggregate(items, ["l_returnflag", "l_linestatus"], sum_qty=agg.exact_sum("l_quantity"), sum_base_price=agg.exact_sum("l_extendedprice"), sum_disc_price=F.sum(price).cast("double"), count_order=F.count("*"))
    return rel.sort(out, "l_returnflag", "l_linestatus")


# -- scans
@query("SELECT * FROM nation")
def scan_all(t: Tables) -> DataFrame:
    return t.scan("nation")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_eq_pushdown(t: Tables) -> DataFrame:
    return t.equal("orders", o_orderstatus="F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12")
def scan_range(t: Tables) -> DataFrame:
    return t.between("lineitem", "l_quantity", 10, 12).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey FROM customer WHERE c_custkey = 5 AND c_nationkey >= 0")
def scan_index_key(t: Tables) -> DataFrame:
    return t.equal("customer", c_custkey=5).where("c_nationkey >= 0").select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def scan_in(t: Tables) -> DataFrame:
    return t.scan("nation", ["n_nationkey", "n_name"], F.col("n_regionkey").isin(1, 3))


same_sql("scan_compare", "SELECT n_nationkey, n_nationkey < 5 AS lt, n_nationkey <= 5 AS le, n_nationkey > 5 AS gt, n_nationkey >= 5 AS ge, n_nationkey <> 5 AS ne, n_nationkey != 5 AS ne2 FROM {nation}")
same_sql("select_literals", "SELECT 7 AS a, 'x' AS b, CAST(NULL AS INT) AS c, TRUE AS d, 2.5e0 AS e")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v(k, s)")
def values_list(t: Tables) -> DataFrame:
    return literals(t.spark, [(1, "a"), (2, None), (3, "c")], "k int, s string")


same_sql("derived_table", "SELECT s.r, s.n FROM (SELECT n_regionkey AS r, COUNT(*) AS n FROM {nation} GROUP BY n_regionkey) s WHERE s.n > 1")

# -- predicates and expressions
same_sql("filter_3vl", "SELECT n_nationkey, a, b FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS a, NULLIF(n_regionkey, 2) AS b FROM {nation}) x WHERE (a > 2 OR b IS NULL) AND NOT (a = 3)")
same_sql("is_null", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NULL AS is_null, NULLIF(n_regionkey, 1) IS NOT NULL AS is_not_null FROM {nation}")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_quantity + 1 AS q1, l_linenumber % 3 AS m, l_extendedprice / NULLIF(l_quantity, 0) AS unit FROM lineitem")
def project_arith(t: Tables) -> DataFrame:
    items = t.scan("lineitem")
    return items.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), (F.col("l_quantity") + 1).alias("q1"), (F.col("l_linenumber") % 3).alias("m"), safe_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit"))


same_sql("between", "SELECT l_orderkey, l_linenumber, l_discount FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.06")
same_sql("not_between", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity NOT BETWEEN 2 AND 49")
same_sql("in_list", "SELECT n_nationkey FROM {nation} WHERE NULLIF(n_regionkey, 1) IN (0, 2, NULL)")
same_sql("not_in_list", "SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (0, 2)")
same_sql("not_in_list_null", "SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (0, NULL)")
same_sql("in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 1000)")
same_sql("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_suppkey IS NOT NULL)")
same_sql("not_in_subquery_null", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 0) FROM {region})")


@query("SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F')")
def exists_uncorrelated(t: Tables) -> DataFrame:
    return jn.if_any(t.scan("region", ["r_regionkey", "r_name"]), t.equal("orders", o_orderstatus="F"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def exists_correlated(t: Tables) -> DataFrame:
    return jn.exists(t.scan("orders", ["o_orderkey"]), t.scan("lineitem", where="l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def not_exists(t: Tables) -> DataFrame:
    return jn.not_exists(t.scan("orders", ["o_orderkey"]), t.scan("lineitem", ["l_orderkey"]), F.col("o_orderkey") == F.col("l_orderkey"))


same_sql("like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%r_n%'")
same_sql("not_like", "SELECT p_partkey FROM {part} WHERE p_name NOT LIKE 'b%'")
same_sql("case_simple", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k FROM {nation}")
same_sql("case_searched", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' END AS size FROM {lineitem}")
same_sql("unary_minus", "SELECT n_nationkey, -n_regionkey AS neg, +n_regionkey AS pos FROM {nation}")
same_sql("concat", "SELECT n_nationkey, n_name || '-' || 'x' AS label FROM {nation}")
same_sql("scalar_subquery", "SELECT n_nationkey, (SELECT MAX(r_regionkey) FROM {region}) AS top FROM {nation}")
same_sql("qualified_names", "SELECT n.n_nationkey AS a, r.r_name AS b FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
same_sql("wildcards", "SELECT r.*, n.n_name FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey")


@query("SELECT DISTINCT l_returnflag FROM lineitem")
def distinct_one(t: Tables) -> DataFrame:
    return rel.distinct(t.scan("lineitem"), "l_returnflag")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_multi(t: Tables) -> DataFrame:
    return rel.distinct(t.scan("lineitem"), "l_returnflag", "l_linestatus")


# -- joins
def _joined(how: str, sql_how: str, strategy: str | None = None) -> None:
    """Whole customer and orders."""

    def run(t: Tables) -> DataFrame:
        c, o = t.scan("customer", ["c_custkey"]), t.scan("orders", ["o_orderkey", "o_custkey", "o_totalprice"])
        return jn.join(c, o, F.col("c_custkey") == F.col("o_custkey"), how, strategy).select("c_custkey", "o_orderkey", "o_totalprice")

    run.__name__ = f"join_{strategy or how}"
    query(f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer {sql_how} JOIN orders ON c_custkey = o_custkey")(run)


def _joined_lines(how: str, sql_how: str) -> None:
    """Whole orders and lineitem, with the orders that have no lines on the side that the join keeps."""
    tables = {"orders": ["o_orderkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_linenumber"]}
    left, right = ("lineitem", "orders") if how == "right" else ("orders", "lineitem")

    def run(t: Tables) -> DataFrame:
        joined = jn.join(t.scan(left, tables[left]), t.scan(right, tables[right]), F.col("o_orderkey") == F.col("l_orderkey"), how)
        return joined.select("o_orderkey", "o_totalprice", "l_linenumber")

    run.__name__ = f"join_{how}_lines"
    query(f"SELECT o_orderkey, o_totalprice, l_linenumber FROM {left} {sql_how} JOIN {right} ON o_orderkey = l_orderkey")(run)


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _joined(_how, _sql)
    if _how != "inner":
        _joined_lines(_how, _sql)
for _strategy in ("hash", "merge", "broadcast"):
    _joined("inner", "INNER", _strategy)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return jn.join(t.scan("region", ["r_name"]), t.scan("nation", ["n_name"]), how="cross")


@query("SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) r JOIN (SELECT n_regionkey AS k, n_name FROM nation) n USING (k)")
def join_using(t: Tables) -> DataFrame:
    return jn.join(t.scan("region").selectExpr("r_regionkey AS k", "r_name"), t.scan("nation").selectExpr("n_regionkey AS k", "n_name"), ["k"])


@query("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey")
def join_theta(t: Tables) -> DataFrame:
    return jn.join(t.scan("region", ["r_regionkey"]), t.scan("nation"), F.col("r_regionkey") < F.col("n_regionkey")).select("r_regionkey", "n_nationkey")


@query("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey >= n_regionkey")
def join_nested_loop(t: Tables) -> DataFrame:
    return jn.join(t.scan("region", ["r_regionkey"]), t.scan("nation"), F.col("r_regionkey") >= F.col("n_regionkey"), strategy="nested_loop").select("r_regionkey", "n_nationkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.scan("nation").alias("a"), t.scan("nation").alias("b")
    return jn.join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


same_sql(
    "join_multiway",
    "SELECT r_name, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY r_name",
)
same_sql("join_comma", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(t: Tables) -> DataFrame:
    return jn.exists(t.scan("customer", ["c_custkey"]), t.scan("orders", ["o_custkey"]), F.col("c_custkey") == F.col("o_custkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return jn.not_exists(t.scan("customer", ["c_custkey"]), t.scan("supplier", ["s_suppkey"]), F.col("c_custkey") == F.col("s_suppkey"))


# -- aggregation
@query("SELECT l_returnflag, COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 1)) AS some, CAST(SUM(l_linenumber) AS BIGINT) AS total, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY l_returnflag")
def group_count_sum(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("lineitem"), ["l_returnflag"], n="count(*)", some="count(nullif(l_linenumber, 1))", total="sum(l_linenumber)", qty=agg.exact_sum("l_quantity"))


@query("SELECT l_returnflag, AVG(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag")
def group_avg(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("lineitem"), ["l_returnflag"], mean="avg(l_linenumber)")


@query("SELECT l_returnflag, MIN(l_shipdate) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
def group_minmax(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("lineitem"), ["l_returnflag"], lo="min(l_shipdate)", hi="max(l_extendedprice)")


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def count_distinct(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("lineitem"), ["l_returnflag"], suppliers=F.countDistinct("l_suppkey"))


@query("SELECT COUNT(*) AS n, MAX(o_totalprice) AS top, COUNT(DISTINCT o_custkey) AS customers FROM orders")
def global_agg(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("orders"), [], n="count(*)", top="max(o_totalprice)", customers="count(DISTINCT o_custkey)")


@query("SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
def global_agg_empty(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("orders", where="o_orderkey < 0"), [], n="count(*)", s="sum(o_custkey)", lo="min(o_orderkey)")


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def having(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("orders"), ["o_custkey"], "n > 12", n="count(*)")


@query("SELECT l_linenumber % 2 AS odd, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber % 2")
def group_by_expr(t: Tables) -> DataFrame:
    return agg.aggregate(t.scan("lineitem"), [(F.col("l_linenumber") % 2).alias("odd")], n="count(*)")


# -- order, limit
same_sql("sort_multi", "SELECT n_regionkey, n_name, n_nationkey FROM {nation} ORDER BY n_regionkey DESC NULLS FIRST, n_name ASC NULLS LAST, n_nationkey ASC NULLS LAST")


@query("SELECT k, n_nationkey FROM (SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation) ORDER BY k DESC NULLS FIRST, n_nationkey ASC NULLS LAST")
def sort_nulls(t: Tables) -> DataFrame:
    return rel.sort(t.scan("nation").selectExpr("nullif(n_regionkey, 2) AS k", "n_nationkey"), "-k", "n_nationkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey ASC NULLS LAST LIMIT 5")
def limit(t: Tables) -> DataFrame:
    return rel.page(rel.sort(t.scan("nation", ["n_nationkey"]), "n_nationkey"), 5)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey ASC NULLS LAST LIMIT 5 OFFSET 7")
def limit_offset(t: Tables) -> DataFrame:
    return rel.page(rel.sort(t.scan("nation", ["n_nationkey"]), "n_nationkey"), 5, 7)


@query("SELECT n_nationkey FROM nation LIMIT 0")
def limit_zero(t: Tables) -> DataFrame:
    return rel.page(t.scan("nation", ["n_nationkey"]), 0)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 20")
def topk(t: Tables) -> DataFrame:
    return rel.page(rel.sort(t.scan("orders", ["o_orderkey", "o_totalprice"]), "-o_totalprice", "o_orderkey"), 20)


# -- set operations
def _sets() -> None:
    for kind in ("union", "intersect", "except"):
        for every in (True, False):

            def run(t: Tables, kind: str = kind, every: bool = every) -> DataFrame:
                return rel.combine(kind, [t.scan("supplier").selectExpr("s_nationkey AS k"), t.scan("customer").selectExpr("c_nationkey AS k")], every)

            run.__name__ = f"{kind}{'_all' * every}"
            query(f"SELECT s_nationkey AS k FROM supplier {kind.upper()}{' ALL' * every} SELECT c_nationkey FROM customer")(run)


_sets()


@query("SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT s_nationkey FROM supplier) u ORDER BY k ASC NULLS LAST")
def setop_chain(t: Tables) -> DataFrame:
    parts = [t.scan("nation").selectExpr("n_nationkey AS k"), t.scan("region").selectExpr("r_regionkey AS k"), t.scan("supplier").selectExpr("s_nationkey AS k")]
    return rel.sort(rel.combine("union", parts), "k")


# -- functions
@query("SELECT n_nationkey, UPPER(n_name) AS up, LOWER(n_name) AS low, TRIM('  ' || n_name || ' ') AS trimmed, LENGTH(n_name) AS len FROM nation")
def fn_upper_lower_trim_length(t: Tables) -> DataFrame:
    name = F.col("n_name")
    return t.scan("nation").select("n_nationkey", SCALAR["UPPER"](name).alias("up"), SCALAR["LOWER"](name).alias("low"), SCALAR["TRIM"](F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), SCALAR["LENGTH"](name).cast("long").alias("len"))


# -- all clauses at once
same_sql(
    "full_chain",
    """SELECT DISTINCT n_name, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {nation} ON c_nationkey = n_nationkey
  WHERE o_totalprice BETWEEN 100 AND 400000 AND NOT (o_orderstatus = 'P') GROUP BY n_name HAVING COUNT(*) > 2 ORDER BY n DESC NULLS FIRST, n_name ASC NULLS LAST LIMIT 10 OFFSET 1""",
)


# -- changes: on tables of the engine in a folder of their own
_FOLDERS: list[Engine] = []


def _folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir, or a temporary one on a single
    machine. It goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    return f"{root.rstrip('/')}/quern-db-{uuid.uuid4().hex}"


@atexit.register
def _clear() -> None:
    while _FOLDERS:
        with contextlib.suppress(Exception):  # the session is gone, and its cluster cleans up
            _FOLDERS.pop().catalog.files.delete("")


def change(sql: str | None) -> Callable[[Callable[[Session, Tables], str]], Callable[[Session, Tables], str]]:
    """Register steps that end with the query whose rows count."""

    def add(f: Callable[[Session, Tables], str]) -> Callable[[Session, Tables], str]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = Engine(spark, _folder(spark))
            _FOLDERS.append(engine)
            with engine.connect() as session:
                return session.execute(f(session, Tables(session.spark, sf_dir))).frame

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _nations(s: Session, t: Tables) -> None:
    t.scan("nation").createOrReplaceTempView("source")
    s.execute("CREATE TABLE n (k INTEGER PRIMARY KEY, name TEXT NOT NULL, r INTEGER DEFAULT 9)")
    s.execute("INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM source")


@change("SELECT * FROM (VALUES (1, 'a', 9), (2, 'b', 3)) v(k, name, r)")
def dml_insert_values(s: Session, t: Tables) -> str:
    s.execute("CREATE TABLE n (k INTEGER PRIMARY KEY, name TEXT NOT NULL, r INTEGER DEFAULT 9)")
    s.execute("INSERT INTO n (k, name) VALUES (1, 'a')")
    s.execute("INSERT INTO n VALUES (1 + 1, 'b', 3)")
    return "SELECT * FROM n"


@change("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
def dml_insert_select(s: Session, t: Tables) -> str:
    _nations(s, t)
    return "SELECT * FROM n"


@change("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN UPPER(n_name) || '!' ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN n_nationkey * 2 ELSE n_regionkey END AS r FROM nation")
def dml_update(s: Session, t: Tables) -> str:
    _nations(s, t)
    s.execute("UPDATE n SET name = upper(name) || '!', r = k * 2 WHERE r = 1")
    return "SELECT * FROM n"


@change("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE NOT (n_nationkey > 10 OR n_regionkey = 0)")
def dml_delete(s: Session, t: Tables) -> str:
    _nations(s, t)
    s.execute("DELETE FROM n WHERE k > 10 OR r = 0")
    return "SELECT * FROM n"


@change("SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 7")
def txn_commit(s: Session, t: Tables) -> str:
    _nations(s, t)
    with s.begin():
        s.execute("DELETE FROM n WHERE r = 2")
        s.execute("INSERT INTO n VALUES (100, 'new', 7)")
    return "SELECT k, r FROM n"


@change("SELECT n_nationkey AS k, n_regionkey AS r FROM nation")
def txn_rollback(s: Session, t: Tables) -> str:
    _nations(s, t)
    s.execute("BEGIN TRANSACTION")
    s.execute("DELETE FROM n")
    s.execute("ROLLBACK")
    return "SELECT k, r FROM n"


@change("SELECT CAST(n_nationkey AS BIGINT) AS key, n_regionkey AS r, 5 AS extra FROM nation")
def alter_table(s: Session, t: Tables) -> str:
    _nations(s, t)
    for sql in ("ALTER TABLE n ADD COLUMN extra INTEGER NOT NULL DEFAULT 5", "ALTER TABLE n RENAME COLUMN k TO key", "ALTER TABLE n MODIFY COLUMN key BIGINT", "ALTER TABLE n DROP COLUMN name", "ALTER TABLE n RENAME TO m", "ALTER TABLE m ADD CONSTRAINT pos CHECK (key >= 0)", "ALTER TABLE m DROP CONSTRAINT pos", "CREATE INDEX i ON m (r)"):
        s.execute(sql)
    return "SELECT * FROM m"


@change("SELECT 'pk' AS kind, 2005 AS code UNION ALL SELECT 'null', 2000 UNION ALL SELECT 'check', 2000 UNION ALL SELECT 'fk', 2005 UNION ALL SELECT 'parent', 2005")
def constraints(s: Session, t: Tables) -> str:
    from quern.engine.errors import EngineError

    s.execute_script("CREATE TABLE p (id INTEGER PRIMARY KEY, v INTEGER NOT NULL CHECK (v > 0)); CREATE TABLE c (p INTEGER REFERENCES p); INSERT INTO p VALUES (1, 1); INSERT INTO c VALUES (1)")
    found = []
    for kind, sql in (("pk", "INSERT INTO p VALUES (1, 2)"), ("null", "INSERT INTO p (id) VALUES (2)"), ("check", "INSERT INTO p VALUES (2, 0)"), ("fk", "INSERT INTO c VALUES (5)"), ("parent", "DELETE FROM p")):
        try:
            s.execute(sql)
        except EngineError as e:
            found.append(f"('{kind}', {e.code})")
    return f"SELECT * FROM VALUES {', '.join(found)} AS v(kind, code)"


@change("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 3")
def prepared(s: Session, t: Tables) -> str:
    _nations(s, t)
    s.execute("PREPARE q AS SELECT k FROM n WHERE r = ?")
    return "EXECUTE q (3)"


@change(None)
def explain(s: Session, t: Tables) -> str:
    _nations(s, t)
    return "EXPLAIN ANALYZE SELECT k FROM n WHERE r = 3"


def _said(s: Session, frame: DataFrame, name: str) -> str:
    frame.createOrReplaceTempView(name)
    return name


@change("SELECT 'Rows: ' || CAST(COUNT(*) AS VARCHAR) AS line FROM nation WHERE n_regionkey = 3")
def explain_analyze(s: Session, t: Tables) -> str:
    _nations(s, t)
    plan = _said(s, s.execute("EXPLAIN ANALYZE SELECT k FROM n WHERE r = 3").frame, "plan")
    return f"SELECT `QUERY PLAN` AS line FROM {plan} WHERE `QUERY PLAN` LIKE 'Rows: %'"


@change("SELECT * FROM (VALUES ('insert', 25), ('update', (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1)), ('delete', (SELECT COUNT(*) FROM nation WHERE n_nationkey > 10))) v(kind, affected)")
def rows_affected(s: Session, t: Tables) -> str:
    t.scan("nation").createOrReplaceTempView("source")
    s.execute("CREATE TABLE n (k INTEGER PRIMARY KEY, name TEXT, r INTEGER)")
    steps = {"insert": "INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM source", "update": "UPDATE n SET name = 'x' WHERE r = 1", "delete": "DELETE FROM n WHERE k > 10"}
    found = ", ".join(f"('{kind}', {s.execute(sql).rows_affected}L)" for kind, sql in steps.items())
    return f"SELECT * FROM VALUES {found} AS v(kind, affected)"


@change("SELECT n_nationkey AS k, 2005 AS code FROM nation")
def unique_keys(s: Session, t: Tables) -> str:
    """Each name again under another key: the key that repeats is found for the set, and nothing changes."""
    from quern.engine.errors import EngineError

    _nations(s, t)
    s.execute("ALTER TABLE n ADD CONSTRAINT names UNIQUE (name)")
    try:
        s.execute("INSERT INTO n SELECT n_nationkey + 100, n_name, n_regionkey FROM source")
        code = 0
    except EngineError as e:
        code = e.code
    return f"SELECT k, {code} AS code FROM n"


@change("SELECT * FROM (VALUES ('drop parent', 2005), ('drop all', 0), ('select', 2000)) v(step, code)")
def drop_table(s: Session, t: Tables) -> str:
    from quern.engine.errors import EngineError

    _nations(s, t)
    s.execute("CREATE TABLE child (k INTEGER REFERENCES n)")
    found = []
    for step, sql in (("drop parent", "DROP TABLE n"), ("drop all", "DROP TABLE n CASCADE"), ("select", "SELECT * FROM child")):
        try:
            s.execute(sql)
            found.append(f"('{step}', 0)")
        except EngineError as e:
            found.append(f"('{step}', {e.code})")
    return f"SELECT * FROM VALUES {', '.join(found)} AS v(step, code)"


@change("SELECT 'child' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'parent', COUNT(*) - 1 FROM nation UNION ALL SELECT 'failed', 1")
def foreign_keys_between_sessions(s: Session, t: Tables) -> str:
    """One session adds a child while another deletes its parent: one of the two fails."""
    from quern.engine.errors import EngineError

    _nations(s, t)
    s.execute("CREATE TABLE child (k INTEGER REFERENCES n)")
    failed = 0
    with s.engine.connect() as other:
        s.execute("BEGIN TRANSACTION")
        s.execute("INSERT INTO child VALUES (7)")
        other.execute("DELETE FROM n WHERE k = 7")
        try:
            s.execute("COMMIT")
        except EngineError:
            failed += 1
    return f"SELECT 'child' AS what, count(*) AS n FROM child UNION ALL SELECT 'parent', count(*) FROM n UNION ALL SELECT 'failed', {failed}L"


@change("SELECT 'k' AS column_name, COUNT(*) AS row_count, CAST(MIN(n_nationkey) AS VARCHAR) AS low, CAST(MAX(n_nationkey) AS VARCHAR) AS high FROM nation UNION ALL SELECT 'name', COUNT(*), MIN(n_name), MAX(n_name) FROM nation UNION ALL SELECT 'r', COUNT(*), CAST(MIN(n_regionkey) AS VARCHAR), CAST(MAX(n_regionkey) AS VARCHAR) FROM nation")
def statistics(s: Session, t: Tables) -> str:
    _nations(s, t)
    found = _said(s, s.execute("ANALYZE TABLE n").frame, "found")
    return f"SELECT column_name, row_count, low, high FROM {found}"


@change("SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def sort_aggregation(s: Session, t: Tables) -> str:
    """Groups by sorting: hash aggregation is off for the statement's session."""
    _nations(s, t)
    s.spark.conf.set("spark.sql.execution.useHashAggregateExec", "false")
    return "SELECT r, count(*) AS n FROM n GROUP BY r"


@change("SELECT * FROM (VALUES ('district', 3, 3), ('oorder', 3, 6), ('customer', 2, -2), ('new_order', 1, 3)) v(what, n, total)")
def tpcc_transactions(s: Session, t: Tables) -> str:
    tpcc.seed(s)
    o = [tpcc.Order(i, d, 7, 9, 5) for i, d in ((1, 1), (2, 1), (3, 2))]
    for x in o:
        tpcc.perform(s, "new_order", x)
    for x in o[1:]:
        tpcc.perform(s, "payment", x)
    for kind in ("order_status", "stock_level", "delivery"):
        tpcc.perform(s, kind, o[0])
    return """SELECT 'district' AS what, cast(sum(d_next_o_id - 1) AS int) AS n, cast(sum(d_next_o_id - 1) AS int) AS total FROM district
      UNION ALL SELECT 'oorder', cast(count(*) AS int), cast(sum(o_id) AS int) FROM oorder
      UNION ALL SELECT 'customer', cast(count_if(c_balance < 0) AS int), cast(sum(c_balance) AS int) FROM customer
      UNION ALL SELECT 'new_order', cast(count(*) AS int), cast(sum(no_o_id) AS int) FROM new_order"""
