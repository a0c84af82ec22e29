import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.functions.sqltypes import ColumnType, SqlError, comparable, stored
from quern.plans import access
from quern.plans import dialect as D


@given(st.integers(-(2**63), 2**63 - 1), st.sampled_from("=<>"), st.text(alphabet="ab'; \n-", max_size=12))
def test_values_come_back(n, op, text):
    quoted = text.replace("'", "''")
    assert D.parse(f"SELECT a FROM t WHERE a {op} {n}").where == D.Filter("a", op, n)
    assert D.parse(f"DELETE FROM t WHERE a {op}{n};").where == D.Filter("a", op, n)
    assert D.parse(f"INSERT INTO t VALUES ('{quoted}', {n})").rows == [[text, n]]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT", "SELECT a", "SELECT a FROM", "SELECT a FROM t WHERE a <= 1", "SELECT a FROM t WHERE a = .5", "SELECT a FROM t WHERE a = 1.",
        "SELECT a FROM t JOIN u", "SELECT count(a) FROM t", "SELECT a FROM t -- note", 'SELECT "a" FROM t', "SELECT a FROM t WHERE a = 99999999999999999999",
        "CREATE TABLE t (a BOOL)", "CREATE TABLE t (v VECTOR(0))", "CREATE TABLE t (v VECTOR(2001))", "CREATE TABLE t (a INT, A INT)", "INSERT INTO t VALUES ()",
        "SELECT a FROM t WHERE a = $0", "UPDATE t SET", "DROP TABLE t", "SELECT a FROM t LIMIT 1.5", "SELECT a FROM t; ; ",
    ],
)
def test_refused(sql):
    with pytest.raises(SqlError):
        D.parse(sql)


def test_operators_and_numbers_stay_apart():
    assert D.parse("SELECT a FROM t WHERE a <-5").where == D.Filter("a", "<", -5)
    assert D.parse("SELECT v <-> [1,-2.5] FROM t").items == [D.Distance("v", "<->", [1.0, -2.5])]
    assert D.parse("SELECT vector FROM nextval").items == ["vector"]
    assert D.parse("SELECT nextval('S')") == D.SequenceCall("nextval", "s")
    assert D.parse("INSERT INTO t VALUES ([], DEFAULT, NULL)").rows == [[[], D.DEFAULT, None]]


def test_binding():
    s = D.parse("UPDATE t SET a = $3, b = $1 WHERE c > $1")
    bound = D.bind(s, [7, "unused", "x"])
    assert bound.assignments == [("a", "x"), ("b", 7)] and bound.where.value == 7
    for params in ([], [1, 2], [1, 2, 3, 4]):
        with pytest.raises(SqlError):
            D.bind(s, params)


@pytest.mark.parametrize(
    "value, kind",
    [(1.0, "INT4"), (1, "FLOAT8"), ("1", "INT8"), (2**31, "INT4"), (1, "TEXT"), ("x", "UUID"), ([1.0], "TEXT"), (True, "INT4"), (2**63, "TIMESTAMPTZ")],
)
def test_strict_values(value, kind):
    with pytest.raises(SqlError):
        stored(value, ColumnType(kind), "c")


@pytest.mark.parametrize("kind", ["BYTEA", "VECTOR", "UUID"])
def test_not_compared(kind):
    with pytest.raises(SqlError):
        comparable("x", ColumnType(kind, 1), "c")


def test_long_keys_are_scanned_and_paths_can_be_added():
    select = D.parse("SELECT a FROM t WHERE a = '" + "x" * 3000 + "'")
    request = access.Request(select, frozenset({"a"}), None)
    assert access.choose(request).reason == "KeyTooLarge"
    access.REGISTRY.insert(0, ("own", lambda r: r.select.table == "t", lambda r: access.Plan("OwnScan")))
    try:
        assert access.choose(request).path == "OwnScan"
    finally:
        access.REGISTRY.pop(0)
