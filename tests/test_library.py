"""The library's functions, the workload, the stream sink and the command line."""

from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

from quern.engine import tpcc
from quern.engine.lexer import render, statements
from quern.operators import aggregates, joins, relational
from quern.sources import files

ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_operators_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "p"), (None, "q")], "k int, w string")
    assert rows(joins.join(a, b, "k")) == [(2, None, "p")] * 2
    assert rows(joins.join(a, b, ["k"], "full")) == rows(joins.join(a, b, ["k"], "full", "merge"))
    assert len(rows(joins.join(a, b, "k", "full"))) == 5
    assert rows(joins.exists(a, b, "k")) == [(2, None)] * 2 and len(rows(joins.not_exists(a, b, "k"))) == 2
    assert rows(joins.if_any(b, a)) == rows(b) and rows(joins.if_any(b, a.where("k > 5"))) == []
    assert rows(relational.distinct(a)) == [(1, "x"), (2, None), (None, "y")]
    assert [r[0] for r in relational.sort(a, "k", "v").collect()] == [1, 2, 2, None]
    assert [r[0] for r in relational.sort(a, "-k").collect()] == [None, 2, 2, 1]
    assert relational.page(relational.sort(a, "k"), 1, 1).collect()[0][0] == 2
    assert rows(relational.combine("except", [a.select("k"), b.select("k")], True)) == [(1,), (2,)]
    assert rows(aggregates.aggregate(a, ["k"], "n > 1", n="count(*)", m="count(v)")) == [(2, 2, 0)]
    assert rows(aggregates.aggregate(a.where("k > 9"), [], n="count(*)", s="sum(k)")) == [(0, None)]
    assert rows(relational.project(relational.select_where(a, "k = 1 OR v IS NULL"), s="k + 1")) == [(2,), (3,), (3,)]


def test_files(spark, tmp_path):
    df = spark.range(5).selectExpr("id AS k", "concat('v', id) AS v")
    for fmt in files.FORMATS:
        files.write(df, str(tmp_path / fmt), fmt)
        assert rows(files.read(spark, str(tmp_path / fmt), fmt, "k long, v string")) == rows(df)
    with pytest.raises(ValueError):
        files.read(spark, "x", "heap")
    df.write.parquet(str(tmp_path / "t.parquet"))
    t = files.Tables(spark, str(tmp_path))
    assert rows(t.equal("t", k=3)) == [(3, "v3")] and rows(t.between("t", "k", low=3)) == [(3, "v3"), (4, "v4")]


def test_lexer():
    found = statements("""SELECT "a b", 'it''s; ok' -- c; d
      /* ; */ FROM t; ; SELECT 1""")
    assert [render(s) for s in found] == ["SELECT `a b`, 'it\\'s; ok' FROM t", "SELECT 1"]


def test_workload(db):
    tpcc.seed(db)
    assert tpcc.Order.of(1, 5) == tpcc.Order.of(1, 5)
    took = tpcc.replay(db, 4, seed=3, mix={"new_order": 1, "payment": 1, "order_status": 1})
    assert sum(map(len, took.values())) == 4
    n = len(took.get("new_order", []))
    assert db.execute("SELECT sum(d_next_o_id - 1), (SELECT count(*) FROM order_line) FROM district").rows() == [(n, n)]
    assert tpcc.quantile([3.0, 1.0, 2.0], 0.5) == 2.0 and tpcc.quantile([], 0.5) == 0.0


def test_stream_is_appended_once(spark, engine, tmp_path):
    from quern.streaming.ingest import append_stream

    spark.range(6).selectExpr("id AS k").write.parquet(str(tmp_path / "in"))
    with engine.connect() as s:
        s.execute("CREATE TABLE t (k BIGINT PRIMARY KEY)")
    for _ in range(2):  # the second run has lost its checkpoint: it delivers batch 0 again
        stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
        query = append_stream(stream, engine, "t", "ids", str(tmp_path / f"check{_}"), availableNow=True)
        query.awaitTermination()
    assert rows(engine.table("t")) == [(k,) for k in range(6)]


def test_command_line(tmp_path):
    (tmp_path / "batch.sql").write_text("# rows\nINSERT INTO t (a) VALUES (1), (NULL)\nSELECT a FROM t ORDER BY a NULLS LAST\n")
    run = subprocess.run([sys.executable, "-m", "quern", "--data", str(tmp_path / "db"), "--batch-file", str(tmp_path / "batch.sql")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.stdout.splitlines() == ["2 rows affected", "a", "1", "NULL"], run.stderr[-500:]


def test_entry_imports_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("quern.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("quern.llm", "quern.llm.registry", "quern.llm.oracles", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.import_module("__spark_entry__")
    assert "pricing_summary" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    assert entry.oracle_sql()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quern").parts:
            text = path.read_text()
            assert "quern.llm" not in text and "corpus_pipeline" not in text, path


def test_a_broadcast_takes_the_smaller_side_if_it_is_small(spark, monkeypatch):
    few, many = spark.range(20).selectExpr("id AS k"), spark.range(5000).selectExpr("id % 30 AS k", "id AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        want = rows(joins.join(few, many, "k"))
        for a, b, side in ((few, many, "BuildLeft"), (many, few, "BuildRight")):
            joined = joins.join(a, b, ["k"], strategy="broadcast")
            assert "BroadcastHashJoin" in plan(joined) and side in plan(joined) and rows(joined.select("k", "v")) == want
        left = joins.join(many, few, "k", "left", "broadcast")
        assert "BuildRight" in plan(left) and left.count() == 5000
        monkeypatch.setattr(joins, "ROWS", 19)  # too many rows now, on both sides
        joined = joins.join(few, many, "k", strategy="broadcast")
        assert "Broadcast" not in plan(joined) and rows(joined) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
