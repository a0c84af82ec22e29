import math
import threading

import pytest
from pyspark.sql import functions as F

from quern.functions.sqltypes import SqlError
from quern.operators.locks import EXCLUSIVE, Deadlock, LockManager
from quern.session import Engine
from quern.sources.store import Conflict


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture
def s(engine):
    return engine.session()


def rows(s, sql, params=()):
    return s.exec(sql, params).rows()


def test_changes_and_order(s):
    s.exec("CREATE TABLE Crew(NUM INT, Rank TEXT)")
    assert s.exec("INSERT INTO crew VALUES (1, 'a'), (2, 'b'), (NULL, 'it''s')").affected == 3
    assert rows(s, "SELECT num FROM CREW ORDER BY num ASC") == [(1,), (2,), (None,)]
    assert rows(s, "SELECT num FROM crew ORDER BY num DESC LIMIT 1") == [(None,)]
    assert s.exec("UPDATE crew SET rank = 'z' WHERE num > 1").affected == 1
    assert sorted(rows(s, "SELECT rank FROM crew WHERE num < 3")) == [("a",), ("z",)]
    assert s.exec("DELETE FROM crew WHERE num = 1").affected == 1
    assert s.exec("DELETE FROM crew").affected == 2
    assert rows(s, "SELECT * FROM crew") == []


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT nope FROM t", "SELECT id FROM nope", "SELECT id FROM t WHERE id = 'x'", "SELECT id FROM t WHERE f = 1",
        "SELECT id FROM t WHERE id = NULL", "INSERT INTO t (id) VALUES (1)", "INSERT INTO t VALUES (99999999999, 1.0, 'x', NULL)",
        "UPDATE t SET id = DEFAULT", "SELECT id FROM t ORDER BY v", "SELECT v <-> '[1]' FROM t", "SELECT v <=> '[0,0]' FROM t",
        "SELECT id <-> '[1,2]' FROM t", "SELECT id FROM t LIMIT -1", "SELECT id FROM t LIMIT $1", "INSERT INTO t VALUES (1, 1.0, 'x', '[1,2]')",
        "SELECT id FROM t; SELECT id FROM t", "BEGIN; ", "EXPLAIN SELECT v <-> '[1]' FROM t",
    ],
)
def test_refused(s, sql):
    s.exec("CREATE TABLE t (id INT4, f FLOAT8, x TEXT, v VECTOR(2))")
    if sql.startswith("BEGIN"):
        s.begin()
        with pytest.raises(SqlError):
            s.exec("CREATE TABLE u (id INT)")
        with pytest.raises(SqlError, match="failed"):
            s.exec("SELECT id FROM t")
        s.rollback()
    else:
        with pytest.raises(SqlError):
            s.exec(sql)


def test_distances_and_paths(s):
    s.exec("CREATE TABLE t (id INT4, v VECTOR(2))")
    s.exec("CREATE INDEX ON t USING hnsw (v vector_l2_ops)")
    s.exec("INSERT INTO t VALUES (1, [0.0, 0.0]), (2, [3, 4]), (3, NULL), (4, [6.0, 8.0])")
    r = s.exec("SELECT id, v <-> '[0,0]' FROM t ORDER BY v <-> [0, 0] LIMIT 9")
    assert r.path == "HnswScan" and r.frame.columns == ["id", "?column?"]
    assert r.rows() == [(1, 0.0), (2, 5.0), (4, 10.0), (3, None)]
    assert rows(s, "SELECT id FROM t ORDER BY v <-> '[0,0]' DESC") == [(3,), (4,), (2,), (1,)]
    assert rows(s, "SELECT id, v <#> [1, 1] FROM t WHERE id = 2") == [(2, -7.0)]
    with pytest.raises(Exception, match="zero vector"):
        rows(s, "SELECT v <=> [1, 1] FROM t")
    plan = lambda q: rows(s, "EXPLAIN " + q)[0][0]
    d = "SELECT id FROM t"
    assert plan(f"{d} ORDER BY v <-> [1,1] LIMIT 2").startswith("HnswScan")
    for tail, reason in (
        ("ORDER BY v <-> [1,1]", "MissingLimit"), ("ORDER BY v <-> [1,1] DESC LIMIT 1", "Desc"), ("ORDER BY v <#> [1,1] LIMIT 1", "MetricMismatch"),
        ("WHERE id = 1 ORDER BY v <-> [1,1] LIMIT 1", "ExtraWhere"), ("WHERE id = 1", "NoIndex"), ("", "Plain"),
    ):
        assert f"SeqScan reason={reason}" in plan(f"{d} {tail}")
    s.exec("CREATE INDEX ON t (id)")
    assert plan(f"{d} WHERE id > 1") == "BTreeScan column=id op=> rows=3 pages=1"
    s.begin()
    s.exec("INSERT INTO t VALUES (5, [0.1, 0.0])")
    assert "SnapshotFallback" in plan(f"{d} ORDER BY v <-> [0,0] LIMIT 2")
    assert rows(s, f"{d} ORDER BY v <-> [0,0] LIMIT 2") == [(1,), (5,)]
    s.commit()
    assert rows(s, f"{d} ORDER BY v <-> [0,0] LIMIT 2") == [(1,), (5,)]
    assert s.nearest("t", "v", [0, 0], 2).count() == 2
    assert s.engine.hnsw_leak_report("t")["node_count"] == 4


def test_serial_and_sequences(engine, s):
    s.exec("CREATE TABLE items (id SERIAL, note TEXT)")
    s.exec("INSERT INTO items (note) VALUES ('ivy'), ('moss')")
    s.exec("INSERT INTO items VALUES (DEFAULT, 'fern'), (50, 'reed'), (NULL, 'rush')")
    assert sorted(rows(s, "SELECT note, id FROM items")) == [("fern", 3), ("ivy", 1), ("moss", 2), ("reed", 50), ("rush", None)]
    s.begin()
    s.exec("INSERT INTO items (note) VALUES ('gone')")
    s.rollback()
    s.exec("INSERT INTO items (note) VALUES ('f')")
    assert rows(s, "SELECT id FROM items WHERE note = 'f'") == [(5,)]
    s.exec("CREATE SEQUENCE q")
    other = engine.session()
    assert rows(s, "SELECT nextval('q')") == [(1,)] and rows(other, "SELECT nextval('q')") == [(2,)]
    assert rows(s, "SELECT currval('q')") == [(1,)]
    with pytest.raises(SqlError):
        engine.session().exec("SELECT currval('q')")


def test_snapshots_and_conflicts(engine):
    a, b = engine.session(), engine.session()
    a.exec("CREATE TABLE c (id INT, val INT)")
    a.exec("INSERT INTO c VALUES (1, 0)")
    a.begin()
    b.exec("UPDATE c SET val = 1")
    assert rows(a, "SELECT val FROM c") == [(0,)]
    a.exec("UPDATE c SET val = 5")
    assert rows(a, "SELECT val FROM c") == [(5,)]
    with pytest.raises(Conflict):
        a.commit()
    assert rows(b, "SELECT val FROM c") == [(1,)]
    before = engine.vacuum("c")
    assert before["versions_removed"] == 2 and rows(b, "SELECT val FROM c") == [(1,)]
    assert engine.manifests("c").count() == 1


def test_parameters(s):
    s.exec("CREATE TABLE items (id INT4, big INT8, score FLOAT8, name TEXT, v VECTOR(2))")
    s.exec("INSERT INTO items VALUES ($1, $2, $3, $4, $5)", [1, 2**40, 1.5, "x", [1.0, 2.0]])
    assert rows(s, "SELECT big FROM items WHERE name = $1", ["x"]) == [(2**40,)]
    assert [str(t) for t in s.parameter_types("SELECT id FROM items WHERE score > $2 ORDER BY v <-> $1 LIMIT 1")] == ["VECTOR(2)", "FLOAT8"]
    for params in ([], [1, 2], ["x"], [1.0], [2**40]):
        with pytest.raises(SqlError):
            s.exec("DELETE FROM items WHERE id = $1", params)
    with pytest.raises(SqlError):
        s.exec("SELECT id FROM items ORDER BY v <-> $1 LIMIT 1", [[math.nan, 1.0]])


def test_analytics(s, spark):
    s.exec("CREATE TABLE t (id INT8, u UUID, ts TIMESTAMPTZ, v VECTOR(2))")
    rows_in = spark.sql("SELECT id, '550e8400-e29b-41d4-a716-446655440000' AS u, timestamp_micros(1700000000000000 + id) AS ts, array(1.0, id) AS v FROM range(3)")
    s.insert_frame("t", rows_in)
    assert s.analytics("SELECT count(*) AS n FROM t a JOIN t b ON a.id = b.id WHERE a.u = '550E8400E29B41D4A716446655440000'").first().n == 3
    assert s.analytics("SELECT id FROM t WHERE ts > '2023-11-14 22:13:20' AND id = NULL").count() == 0
    for bad in ("DELETE FROM t", "SELECT v <-> v FROM t", "SELECT v <=> v FROM t", "SELECT id FROM t WHERE u = 'x'", "SELECT id FROM t FOR UPDATE"):
        with pytest.raises(SqlError):
            s.analytics(bad)
    with pytest.raises(Exception, match="does not fit"):
        s.insert_frame("t", rows_in.withColumn("v", F.array(F.lit(1.0))))


def test_float_order_and_bytes(s):
    s.exec("CREATE TABLE m (id INT4, score FLOAT8, b BYTEA, ts TIMESTAMPTZ)")
    s.exec("INSERT INTO m VALUES ($1, $2, $3, 1234567), (2, -1.5, 'ab', 0), (3, $4, NULL, NULL)", [1, math.nan, b"\xde\xad", math.inf])
    assert [r[0] for r in rows(s, "SELECT id FROM m ORDER BY score")] == [2, 3, 1]
    assert [r[0] for r in rows(s, "SELECT id FROM m ORDER BY score DESC")] == [1, 3, 2]
    assert rows(s, "SELECT id FROM m WHERE ts > 100") == [(1,)]
    assert bytes(rows(s, "SELECT b FROM m WHERE id = 1")[0][0]) == b"\xde\xad"
    r = s.exec("SELECT id FROM m ORDER BY id")
    assert r.fetch(2) == [(1,), (2,)] and r.fetch(2) == [(3,)]
    assert s.engine.query_stats().count() > 3


def test_row_ids(s):
    s.exec("CREATE TABLE t (id INT8, v TEXT)")
    s.exec("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (2, 'c')")
    s.exec("CREATE INDEX ON t (id)")
    tid = s.index_lookup("t", "id", 2)
    assert s.update_rows("t", [tid], {"v": "z"}) == 1 and s.delete_rows("t", [tid + 1]) == 1
    assert sorted(rows(s, "SELECT id, v FROM t")) == [(1, "a"), (2, "z")]
    s.begin()
    assert rows(s, "SELECT v FROM t WHERE id = 1 FOR UPDATE") == [("a",)]
    assert s.engine.locks.state()
    s.rollback()
    assert not s.engine.locks.state()


def test_deadlock():
    m, failed = LockManager(), []
    m.acquire(1, "a", EXCLUSIVE)
    m.acquire(2, "b", EXCLUSIVE)

    def younger():
        try:
            m.acquire(2, "a", EXCLUSIVE)
        except Deadlock:
            failed.append(2)
            m.release(2)

    t = threading.Thread(target=younger)
    t.start()
    m.acquire(1, "b", EXCLUSIVE)
    t.join()
    assert failed == [2]


def test_leaks_and_rebuild(s):
    s.exec("CREATE TABLE t (id INT4, v VECTOR(2))")
    s.exec("CREATE INDEX ix ON t USING hnsw (v vector_l2_ops)")
    s.exec("INSERT INTO t VALUES " + ", ".join(f"({i}, [{i}, {i % 3}])" for i in range(20)))
    assert s.exec("SELECT id FROM t ORDER BY v <-> [4, 1] LIMIT 2").rows()[0] == (4,)
    s.exec("DELETE FROM t WHERE id < 5")
    before = s.engine.hnsw_leak_report("t")
    assert before["tombstoned_count"] == 5 and before["rebuild_recommended"]
    s.rebuild_graph("t")
    after = s.engine.hnsw_leak_report("t")
    assert after["node_count"] == 15 and after["leak_ratio"] == 0 and after["unreachable_live_count"] == 0
    assert s.exec("SELECT id FROM t ORDER BY v <-> [5, 2] LIMIT 1").rows() == [(5,)]


def test_index_follows_changes(s):
    s.exec("CREATE TABLE t (id INT4, v VECTOR(2))")
    s.exec("CREATE INDEX ix ON t USING hnsw (v vector_l2_ops)")
    for lo in (0, 30):
        s.exec("INSERT INTO t VALUES " + ", ".join(f"({i}, [{i}, 0])" for i in range(lo, lo + 30)))
    near = lambda x: rows(s, f"SELECT id FROM t ORDER BY v <-> [{x}, 0] LIMIT 2")
    layers = lambda: len(s.build_graph(s.store.current("t")).layers)
    assert near(10.05) == [(10,), (11,)] and layers() == 1
    s.exec("INSERT INTO t VALUES (100, [10.2, 0]), (101, NULL)")
    assert near(10.05) == [(10,), (100,)] and layers() == 2
    s.exec("UPDATE t SET v = [50.2, 0] WHERE id = 10")
    assert near(10.05) == [(100,), (11,)] and near(50.2) == [(10,), (50,)] and layers() == 3
    s.exec("UPDATE t SET v = [10, 0] WHERE id = 10")  # back to where it was
    assert near(10.05) == [(10,), (100,)] and near(50.2) == [(50,), (51,)] and layers() == 4
    s.exec("DELETE FROM t WHERE id = 100")
    s.exec("UPDATE t SET id = 1000 WHERE id = 11")  # the vector stays
    assert near(10.05) == [(10,), (1000,)] and layers() == 4
    report = s.engine.hnsw_leak_report("t")
    assert report["tombstoned_count"] == 3 and report["live_count"] == 60
    s.exec("DELETE FROM t WHERE id < 30")  # too many dead: built anew
    assert near(10.05) == [(1000,), (30,)] and layers() == 1
    s.exec("DELETE FROM t WHERE id > 30")
    s.engine.vacuum("t")
    assert near(10.05) == [(30,)] and layers() == 1
    s.exec("DELETE FROM t")
    assert near(10.05) == []
    s.exec("INSERT INTO t VALUES (1, [1, 1])")
    assert near(10.05) == [(1,)]


def test_layers_end(s, monkeypatch):
    monkeypatch.setattr("quern.operators.ann.MAX_LAYERS", 2)
    s.exec("CREATE TABLE t (id INT4, v VECTOR(1))")
    s.exec("CREATE INDEX ix ON t USING hnsw (v vector_l2_ops)")
    for i, n in enumerate((1, 2, 1)):
        s.exec(f"INSERT INTO t VALUES ({i}, [{i}])")
        assert rows(s, f"SELECT id FROM t ORDER BY v <-> [{i}] LIMIT 1") == [(i,)]
        assert len(s.build_graph(s.store.current("t")).layers) == n


def test_script_and_introspection(s):
    s.exec_script("CREATE TABLE a (id INT); INSERT INTO a VALUES (1)")
    with pytest.raises(SqlError):
        s.exec_script("INSERT INTO a VALUES (2); INSERT INTO a VALUES ('x')")
    assert s.exec("SELECT id FROM a").rows() == [(1,)]
    s.exec_script("INSERT INTO a VALUES (2); INSERT INTO a VALUES (3)")
    assert s.engine.table_entries() == ["a"] and s.engine.describe_table("a") == [("id", "INT4")]
    s.exec("CREATE INDEX ON a (id)")
    assert s.engine.indexes("a") == [("btree", "id")] and s.engine.active_transactions() == []
    s.begin()
    assert len(s.engine.active_transactions()) == 1 and s.engine.oldest_versions()["a"] == s.store.current("a").number
    s.rollback()
    s.engine.drop_table("a")
    assert s.engine.table_entries() == []


def test_for_update_blocks_a_writer_until_the_locker_ends(engine, s):
    s.exec("CREATE TABLE t (id INT, v TEXT)")
    s.exec("INSERT INTO t VALUES (1, 'p'), (2, 'q')")
    locker, done = engine.session(), []
    locker.begin()
    assert rows(locker, "SELECT v FROM t WHERE id = 1 FOR UPDATE") == [("p",)]
    writer = threading.Thread(target=lambda: done.append(engine.session().exec("UPDATE t SET v = 'r' WHERE id = 1").affected))
    writer.start()
    assert engine.session().exec("UPDATE t SET v = 's' WHERE id = 2").affected == 1  # another row is free
    assert not done
    locker.rollback()
    writer.join(60)
    assert done == [1] and sorted(rows(s, "SELECT id, v FROM t")) == [(1, "r"), (2, "s")]


def test_two_tables_change_together_or_not_at_all(engine, s, monkeypatch):
    for t in ("a", "b"):
        s.exec(f"CREATE TABLE {t} (id INT)")
    one = engine.session()
    one.begin()
    one.exec("INSERT INTO a VALUES (1)")
    one.exec("INSERT INTO b VALUES (1)")
    s.exec("INSERT INTO b VALUES (2)")
    with pytest.raises(Conflict):
        one.commit()
    assert rows(s, "SELECT * FROM a") == [] and rows(s, "SELECT * FROM b") == [(2,)]
    # another driver that comes in after the look at all tables
    one.begin()
    one.exec("INSERT INTO a VALUES (3)")
    one.exec("INSERT INTO b VALUES (3)")
    commit = engine.store.commit

    def late(v):
        if v.table == "b":
            commit(engine.store.current("b"))
        return commit(v)

    monkeypatch.setattr(engine.store, "commit", late)
    with pytest.raises(Conflict):
        one.commit()
    assert rows(s, "SELECT * FROM a") == [] and rows(s, "SELECT * FROM b") == [(2,)]


def test_drop_waits_for_readers_and_manifests_are_whole(engine, s):
    s.exec("CREATE TABLE t (id INT)")
    s.exec("INSERT INTO t VALUES (1)")
    reader = engine.session()
    reader.begin()
    with pytest.raises(SqlError):
        engine.drop_table("t", 0.1)
    assert rows(reader, "SELECT * FROM t") == [(1,)]
    reader.rollback()
    v = engine.store.current("t")
    name = f"tables/t/versions/{v.number:012d}.json"
    assert not engine.store.files.create(name, {}) and engine.store.current("t") == v
    assert [n for n in engine.store.files.names("tables/t/versions") if not n.endswith(".json")] == []
    engine.drop_table("t", 5)
    assert engine.table_entries() == []
