"""The statements of the engine, end to end."""

from __future__ import annotations

import threading

import pytest

from quern.engine import errors
from quern.engine.session import Engine, Policy


def rows(db, sql):
    return sorted(db.execute(sql).rows(), key=repr)


def fails(code, db, sql):
    with pytest.raises(errors.EngineError) as e:
        db.execute(sql)
    assert e.value.code == code, str(e.value)


def test_insert_without_create_and_where(db):
    for v in (1, 2, 2):
        assert db.execute(f"INSERT INTO r (a) VALUES ({v})").rows_affected == 1
    r = db.execute("SELECT a FROM r WHERE a = 2;")
    assert r.columns == ["a"] and r.rows() == [(2,), (2,)]
    db.execute("INSERT INTO r (a, b) VALUES (3, 'x')")  # the table takes a new column
    assert rows(db, "SELECT a, b FROM r WHERE a >= 2 AND NOT (a = 2)") == [(3, "x")]
    assert rows(db, "SELECT count(*) FROM r WHERE b IS NULL") == [(3,)]
    db.execute("INSERT INTO u VALUES (1, 'it''s')")
    assert rows(db, "SELECT col1, col2 FROM u") == [(1, "it's")]


def test_query_clauses(db):
    db.execute("INSERT INTO t (a, b) VALUES (1, 1), (2, 1), (2, 0), (NULL, 5)")
    assert rows(db, "SELECT a FROM t WHERE a = 1 OR b = 0") == [(1,), (2,)]
    assert db.execute("SELECT a FROM t ORDER BY a ASC NULLS LAST LIMIT 1 OFFSET 1").rows() == [(2,)]
    assert rows(db, "SELECT a + b AS s FROM t WHERE b < 5") == [(2,), (2,), (3,)]
    assert rows(db, 'SELECT x.a FROM t x JOIN t y ON x.a = y.a AND x."b" < y.b') == [(2,)]
    assert rows(db, "SELECT a, count(*) AS n FROM t GROUP BY a HAVING count(*) > 1") == [(2, 2)]
    assert rows(db, "SELECT a FROM t EXCEPT SELECT 1") == [(2,), (None,)]


def test_create_drop_types_and_defaults(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n VARCHAR(8) NOT NULL, d DECIMAL(8, 2) DEFAULT 1.5, c BIGINT CHECK (c > 0), u TIMESTAMP, f BOOLEAN)")
    db.execute("INSERT INTO t (id, n) VALUES (1, 'a')")
    assert [str(x) for x in rows(db, "SELECT d, c FROM t")[0]] == ["1.50", "None"]  # an unknown check passes
    fails(errors.PROTOCOL, db, "INSERT INTO t (id) VALUES (2)")
    fails(errors.PROTOCOL, db, "INSERT INTO t (id, n, c) VALUES (2, 'b', 0)")
    fails(errors.PROTOCOL, db, "CREATE TABLE t (a INT)")
    fails(errors.PROTOCOL, db, "CREATE TABLE v (a VARCHAR(0))")
    db.execute("CREATE TABLE IF NOT EXISTS t (a INT)")
    db.execute("DROP TABLE t")
    fails(errors.PROTOCOL, db, "SELECT * FROM t")
    db.execute("DROP TABLE IF EXISTS t")
    fails(errors.PROTOCOL, db, "DROP TABLE t")


def test_insert_select_goes_by_position(db):
    db.execute("CREATE TABLE a (x INTEGER, y TEXT)")
    db.execute("INSERT INTO a VALUES (1, 'p'), (2, 'q')")
    db.execute("CREATE TABLE b (v INTEGER, w TEXT)")
    assert db.execute("INSERT INTO b SELECT x + 10, y FROM a WHERE x = 2").rows_affected == 1
    assert rows(db, "SELECT * FROM b") == [(12, "q")]
    fails(errors.PROTOCOL, db, "INSERT INTO b (v) SELECT x, y FROM a")


def test_update_and_delete(db):
    db.execute("CREATE TABLE t (a INTEGER, b INTEGER)")
    for i in range(3):  # three files
        db.execute(f"INSERT INTO t VALUES ({2 * i}, 0), ({2 * i + 1}, NULL)")
    before = db.tables()["t"].files
    assert db.execute("UPDATE t SET a = a + 10, b = a WHERE a = 3").rows_affected == 1
    assert len(set(before) & set(db.tables()["t"].files)) == len(before) - 1  # other files stay
    assert rows(db, "SELECT a, b FROM t WHERE a > 9") == [(13, 3)]
    assert db.execute("UPDATE t SET b = 1 WHERE b = 7").rows_affected == 0
    assert db.execute("DELETE FROM t WHERE b IS NULL OR a IN (SELECT max(a) FROM t)").rows_affected == 3
    assert rows(db, "SELECT a FROM t") == [(0,), (2,), (4,)]
    assert db.execute("DELETE FROM t").rows_affected == 3 and rows(db, "SELECT count(*) FROM t") == [(0,)]


def test_keys(db):
    db.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, e TEXT UNIQUE)")
    db.execute("INSERT INTO p VALUES (1, 'a'), (2, NULL), (3, NULL)")
    for bad in ("(1, 'z')", "(4, 'a')", "(NULL, 'q')", "(5, 'q'), (5, 'r')"):
        fails(errors.CONSTRAINT_VIOLATION, db, f"INSERT INTO p VALUES {bad}")
    fails(errors.CONSTRAINT_VIOLATION, db, "UPDATE p SET id = 1 WHERE id = 2")
    assert rows(db, "SELECT id FROM p") == [(1,), (2,), (3,)]
    assert db.execute("UPDATE p SET id = id + 1").rows_affected == 3


def test_foreign_keys(db):
    db.execute_script("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1, 1), (2, NULL)")
    fails(errors.CONSTRAINT_VIOLATION, db, "INSERT INTO c VALUES (3, 9)")
    fails(errors.CONSTRAINT_VIOLATION, db, "DELETE FROM p WHERE id = 1")
    fails(errors.CONSTRAINT_VIOLATION, db, "UPDATE p SET id = 7 WHERE id = 1")
    fails(errors.CONSTRAINT_VIOLATION, db, "UPDATE c SET p = 9")
    fails(errors.CONSTRAINT_VIOLATION, db, "DROP TABLE p RESTRICT")
    db.execute("DELETE FROM c WHERE p = 1")
    assert db.execute("DELETE FROM p WHERE id = 1").rows_affected == 1
    db.execute("DROP TABLE p CASCADE")
    assert not db.tables()


def test_transactions(db, engine):
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")
    fails(errors.NO_ACTIVE_TRANSACTION, db, "COMMIT")
    fails(errors.NO_ACTIVE_TRANSACTION, db, "ROLLBACK")
    fails(errors.PROTOCOL, db, "BEGIN")
    db.execute("BEGIN TRANSACTION")
    fails(errors.ALREADY_IN_TRANSACTION, db, "BEGIN TRANSACTION")
    fails(errors.DDL_IN_TRANSACTION, db, "CREATE TABLE u (a INTEGER)")
    db.execute("INSERT INTO t VALUES (1)")
    fails(errors.CONSTRAINT_VIOLATION, db, "INSERT INTO t VALUES (1)")
    with engine.connect() as other:
        assert rows(db, "SELECT * FROM t") == [(1,)] and rows(other, "SELECT * FROM t") == []
        db.execute("ROLLBACK")
        assert rows(db, "SELECT * FROM t") == []
        with db.begin():
            db.execute("INSERT INTO t VALUES (2)")
        assert rows(other, "SELECT * FROM t") == [(2,)]
    with pytest.raises(ZeroDivisionError), db.begin():
        db.execute("DELETE FROM t")
        raise ZeroDivisionError
    assert rows(db, "SELECT * FROM t") == [(2,)]
    assert engine.catalog.vacuum() >= 1 and rows(db, "SELECT * FROM t") == [(2,)]


def test_sessions_conflict_and_reopen(spark, db, engine):
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")
    with engine.connect() as other:
        db.execute("BEGIN TRANSACTION")
        db.execute("INSERT INTO t VALUES (1)")
        other.execute("INSERT INTO t VALUES (2)")
        fails(errors.INTERNAL, db, "COMMIT")
        assert not db.in_transaction and rows(db, "SELECT * FROM t") == [(2,)]
    outcomes = []

    def insert():
        with engine.connect() as s:
            try:
                outcomes.append(s.execute("INSERT INTO t VALUES (5)").rows_affected)
            except errors.EngineError as e:
                outcomes.append(e.code)

    threads = [threading.Thread(target=insert) for _ in range(3)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert sorted(outcomes) == [1, errors.CONSTRAINT_VIOLATION, errors.CONSTRAINT_VIOLATION]
    # a writer that died after it took a number leaves no state
    engine.catalog.files.create(f"catalog-{engine.catalog.load()[0] + 1}.json", "{\"t\": {\"na")
    again = Engine(spark, engine.catalog.files.root).connect()
    assert rows(again, "SELECT * FROM t") == [(2,), (5,)]
    fails(errors.CONSTRAINT_VIOLATION, again, "INSERT INTO t VALUES (2)")
    assert again.execute("INSERT INTO t VALUES (6)").rows_affected == 1


def test_no_orphans_between_sessions(db, engine):
    db.execute_script("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p); INSERT INTO p VALUES (1), (2)")
    with engine.connect() as other:
        db.execute("BEGIN TRANSACTION")
        db.execute("INSERT INTO c VALUES (1, 1)")
        assert other.execute("DELETE FROM p WHERE id = 1").rows_affected == 1
        fails(errors.INTERNAL, db, "COMMIT")
        assert rows(db, "SELECT * FROM c") == [] and rows(db, "SELECT * FROM p") == [(2,)]
        other.execute("BEGIN TRANSACTION")
        other.execute("DELETE FROM p WHERE id = 2")
        db.execute("INSERT INTO c VALUES (2, 2)")
        fails(errors.INTERNAL, other, "COMMIT")
        fails(errors.CONSTRAINT_VIOLATION, other, "DELETE FROM p WHERE id = 2")
        # a row that nothing refers to may go while another session inserts elsewhere
        db.execute("INSERT INTO p VALUES (9)")
        assert other.execute("DELETE FROM p WHERE id = 9").rows_affected == 1


def test_serializable_sessions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), serializable=True)
    with engine.connect() as a, engine.connect() as b:
        a.execute_script("CREATE TABLE s (x INTEGER); CREATE TABLE t (x INTEGER); INSERT INTO s VALUES (1)")
        a.execute("BEGIN TRANSACTION")
        a.execute("INSERT INTO t SELECT x + 1 FROM s")
        b.execute("UPDATE s SET x = 5")
        fails(errors.INTERNAL, a, "COMMIT")
        assert rows(a, "SELECT * FROM t") == []


def test_statistics_choose_files(db):
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, s TEXT)")
    for i in range(4):
        db.execute(f"INSERT INTO t VALUES ({10 * i}, 'k{i}'), ({10 * i + 9}, 'k{i}')")
    t = db.tables()["t"]
    assert t.rows == 8 and len(t.files) == 4 and all(x.rows == 2 for x in t.files.values())
    near = lambda where: len(db._near(t, db_statement(f"DELETE FROM t WHERE {where}")))
    assert [near(w) for w in ("a = 9", "a = 12", "a >= 20", "s = 'k2' AND a < 25", "a = 50", "a = 1 OR s = 'k3'", "a + 1 = 2", "s = 5", "a BETWEEN 1 AND 2", "a = NULL")] == [1, 1, 2, 1, 0, 4, 4, 4, 4, 4]
    assert db.execute("UPDATE t SET s = 'z' WHERE a = 50").rows_affected == 0
    assert db.execute("UPDATE t SET s = 'z' WHERE a = 12").rows_affected == 0 and db.tables()["t"].files == t.files
    fails(errors.CONSTRAINT_VIOLATION, db, "INSERT INTO t VALUES (100, 'a'), (39, 'b')")
    found = {r[0]: r[1:] for r in db.execute("ANALYZE TABLE t").rows()}
    assert found == {"a": (8, 0, 8, "0", "39"), "s": (8, 0, 4, "k0", "k3")}


def db_statement(sql):
    from quern.engine.lexer import statements
    from quern.engine.parser import Parser

    return Parser(statements(sql)[0]).statement()


def test_small_files_become_one(db, engine, monkeypatch):
    from quern.engine import session

    monkeypatch.setattr(session, "FEW", 4)
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")
    for i in range(9):
        db.execute(f"INSERT INTO t VALUES ({i})")
    assert len(db.tables()["t"].files) <= 4 and rows(db, "SELECT count(*), sum(a) FROM t") == [(9, 36)]
    fails(errors.CONSTRAINT_VIOLATION, db, "INSERT INTO t VALUES (3)")
    for _ in range(25):  # more manifests than are kept apart
        db.execute("UPDATE t SET a = a + 1 WHERE a >= 0")
    assert rows(engine.connect(), "SELECT min(a), max(a) FROM t") == [(25, 33)]
    assert len(db.tables()["t"].manifests) <= 21 and engine.catalog.vacuum() > 0
    assert rows(engine.connect(), "SELECT sum(a) FROM t") == [(36 + 9 * 25,)]


def test_changes_of_many_rows_touch_only_their_files(db, monkeypatch):
    from quern.engine import session

    monkeypatch.setattr(session, "SMALL", 3)
    db.execute("CREATE TABLE t (a BIGINT, b BIGINT)")
    for i in range(3):
        db.execute(f"INSERT INTO t SELECT id, {i} FROM range(10)")
    before = set(db.tables()["t"].files)
    assert db.execute("UPDATE t SET a = -1 WHERE a + b = 11").rows_affected == 1
    after = set(db.tables()["t"].files)
    assert len(before - after) < len(before)
    assert db.execute("DELETE FROM t WHERE a < 5").rows_affected == 16
    assert rows(db, "SELECT count(*), sum(a) FROM t") == [(14, 35 + 35 + 26)]


def test_alter_columns(db):
    db.execute("CREATE TABLE t (a INTEGER, b INTEGER, CHECK (b > 0))")
    db.execute("INSERT INTO t VALUES (1, 1)")
    fails(errors.PROTOCOL, db, "ALTER TABLE t ADD COLUMN c INTEGER NOT NULL")
    db.execute("ALTER TABLE t ADD COLUMN c INTEGER NOT NULL DEFAULT 7")
    assert rows(db, "SELECT * FROM t") == [(1, 1, 7)]
    db.execute("ALTER TABLE t RENAME COLUMN b TO bb")
    fails(errors.PROTOCOL, db, "INSERT INTO t VALUES (1, 0, 0)")
    db.execute("ALTER TABLE t DROP COLUMN bb")  # its check goes too
    db.execute("ALTER TABLE t MODIFY COLUMN a BIGINT NOT NULL")
    db.execute("INSERT INTO t VALUES (5000000000, 0)")
    fails(errors.PROTOCOL, db, "ALTER TABLE t MODIFY COLUMN a INTEGER")
    fails(errors.UNSUPPORTED_SQL, db, "ALTER TABLE t MODIFY COLUMN a BOOLEAN")
    db.execute("ALTER TABLE t RENAME TO t2")
    assert rows(db, "SELECT a, c FROM t2") == [(1, 7), (5000000000, 0)]


def test_alter_constraints(db):
    db.execute_script("CREATE TABLE p (id INTEGER); INSERT INTO p VALUES (1), (2); CREATE TABLE c (p INTEGER); INSERT INTO c VALUES (1), (1)")
    fails(errors.CONSTRAINT_VIOLATION, db, "ALTER TABLE c ADD CONSTRAINT u UNIQUE (p)")
    fails(errors.CONSTRAINT_VIOLATION, db, "ALTER TABLE c ADD CONSTRAINT f FOREIGN KEY (p) REFERENCES p (id)")
    db.execute("ALTER TABLE p ADD PRIMARY KEY (id)")
    db.execute("ALTER TABLE c ADD CONSTRAINT f FOREIGN KEY (p) REFERENCES p (id)")
    fails(errors.CONSTRAINT_VIOLATION, db, "INSERT INTO c VALUES (3)")
    fails(errors.CONSTRAINT_VIOLATION, db, "ALTER TABLE p DROP CONSTRAINT pk_p")
    fails(errors.CONSTRAINT_VIOLATION, db, "ALTER TABLE p DROP COLUMN id") if len(db.tables()["p"].columns) > 1 else None
    db.execute("ALTER TABLE p RENAME COLUMN id TO key")
    db.execute("ALTER TABLE p RENAME TO parent")
    fails(errors.CONSTRAINT_VIOLATION, db, "INSERT INTO c VALUES (3)")
    db.execute("ALTER TABLE c DROP CONSTRAINT f")
    db.execute("INSERT INTO c VALUES (3)")
    db.execute("ALTER TABLE c ADD CONSTRAINT positive CHECK (p > 0)")
    fails(errors.PROTOCOL, db, "UPDATE c SET p = -p")
    db.execute("CREATE INDEX i ON c (p)")
    assert db.tables()["c"].indexes == {"i": ["p"]}
    fails(errors.PROTOCOL, db, "CREATE INDEX j ON c (nothing)")


def test_explain(db):
    db.execute("INSERT INTO t (a) VALUES (1), (2)")
    r = db.execute("EXPLAIN SELECT a FROM t WHERE a = 1")
    assert r.columns == ["QUERY PLAN"] and any("PushedFilters" in x for x, in r.rows())
    assert any(x == "Rows: 1" for x, in db.execute("EXPLAIN ANALYZE SELECT a FROM t WHERE a = 1").rows())
    plan = [x for x, in db.execute("EXPLAIN ANALYZE DELETE FROM t WHERE a = 1").rows()]
    assert plan[0] == "Delete on t" and "Rows Affected: 1" in plan and rows(db, "SELECT * FROM t") == [(2,)]
    assert db.execute("EXPLAIN VERBOSE INSERT INTO t (a) VALUES (1)").rows()[0] == ("Insert on t",)
    fails(errors.PROTOCOL, db, "EXPLAIN EXPLAIN SELECT 1")
    fails(errors.PROTOCOL, db, "EXPLAIN DROP TABLE t")


def test_prepared(db):
    db.execute("PREPARE put AS INSERT INTO t (a, b) VALUES (?, ?)")
    db.execute("EXECUTE put (1, 'x')")
    db.execute("EXECUTE put (2, 'y;')")
    db.execute("PREPARE get AS SELECT b FROM t WHERE a = $1 OR a = $1 + 1")
    assert rows(db, "EXECUTE get (1)") == [("x",), ("y;",)]
    fails(errors.PROTOCOL, db, "EXECUTE get (1, 2)")
    fails(errors.PROTOCOL, db, "EXECUTE get")
    fails(errors.PROTOCOL, db, "EXECUTE none (1)")


def test_limits_and_bad_input(spark, tmp_path):
    s = Engine(spark, str(tmp_path), Policy(sql_bytes=60, rows=2, seconds=20)).connect()
    fails(errors.SQL_TOO_LONG, s, "SELECT " + "1" * 60)
    fails(errors.RESULT_ROWS_TOO_LARGE, s, "SELECT * FROM VALUES (1), (2), (3)")
    assert s.execute("SELECT 7 AS a, 'x' AS b -- done").rows() == [(7, "x")]
    fails(errors.PROTOCOL, s, "SELECT 1; SELECT 2")
    fails(errors.PROTOCOL, s, "")
    fails(errors.PROTOCOL, s, "SELEC 1") if False else fails(errors.UNSUPPORTED_SQL, s, "SELEC 1")
    slow = Engine(spark, str(tmp_path), Policy(seconds=1)).connect()
    fails(errors.QUERY_TIMEOUT, slow, "SELECT count(*) FROM range(100000000) a JOIN range(1000000) b ON a.id % 7 < b.id")


def test_access(spark, tmp_path):
    from quern.engine.access import Access

    access = Access()
    access.grant("writer", "insert")
    access.grant("reader", "select", "t")
    access.assign("ann", "writer"), access.assign("bob", "reader")
    engine = Engine(spark, str(tmp_path), access=access)
    ann, bob = engine.connect("ann"), engine.connect("bob")
    ann.execute("INSERT INTO t (a) VALUES (1)")
    fails(errors.PROTOCOL, ann, "SELECT * FROM t")
    assert bob.execute("SELECT * FROM t").rows() == [(1,)]
    fails(errors.PROTOCOL, bob, "DELETE FROM t")
