import random

import pytest

from lodestone.errors import AmbiguousColumn, DialectError, TypeMismatch, UnknownColumn, UnknownTable
from lodestone.session import Analytics

ROWS = [(1, "opal", "bay", 31), (2, "otter", None, 31), (3, "sepal", "cape", 12), (4, "oval", "bay", None), (5, None, "d[e", 58)]


@pytest.fixture(scope="module")
def a(spark):
    out = Analytics(spark)
    out.register_frame("things", spark.createDataFrame(ROWS, "id long, label string, spot string, mass long"))
    out.register_frame("marks", spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "thing_id long, mark string"))
    out.register_frame("nums", spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, None)], "k long, v long"))
    out.register_frame("texts", spark.createDataFrame([("a",)], "id string"))
    return out


def ids(a, where):
    return sorted(r[0] for r in a.execute(f"select id from things where {where}").rows())


@pytest.mark.parametrize(
    "where,want",
    [
        ("spot = null", [2]), ('spot != "bay"', [2, 3, 5]), ("spot in (cape, null)", [2, 3]), ('spot in ("")', []), ("mass > 30", [1, 2, 5]), ("mass <= 31", [1, 2, 3]), ("mass > null", []),
        ('label like "o*"', [1, 2, 4]), ('label like "*al"', [1, 3, 4]), ('label like "*pa*"', [1, 3]), ('label like "o??l"', [1, 4]), ('label like "*"', [1, 2, 3, 4]), ('label like "o*l"', [1, 4]), ('spot like "d[e"', [5]),
        ('spot like "?[?"', [5]), ("label is null", [5]), ("spot is not null and mass is not null", [1, 3, 5]), ('(mass gte 30 and spot = "cape") or spot = "bay"', [1, 4]), ("id <> 1 and id lt 4", [2, 3]),
        ("things.id = 2", [2]), ("mass > 30 or spot = null", [1, 2, 5]), ('label like "s*" or mass < 40', [1, 2, 3]), ("mass in (12, null)", [3, 4]),
    ],
)
def test_predicates(a, where, want):
    assert ids(a, where) == want


def test_predicate_errors(a):
    for where, error in (("nope = 1", UnknownColumn), ('label > "a"', TypeMismatch), ("id like 1", TypeMismatch), ("id = x", TypeMismatch), ("ID = 1", UnknownColumn)):
        with pytest.raises(error):
            a.execute(f"select id from things where {where}")
    with pytest.raises(UnknownTable):
        a.execute("select * from nothing")


def test_random_conditions(a):
    """Random trees against a small evaluator of the NULL rules."""
    r = random.Random(4)
    cols = {"id": 0, "label": 1, "spot": 2, "mass": 3}

    def leaf():
        c = r.choice(list(cols))
        if c in ("id", "mass"):
            op, v = r.choice(["=", "!=", ">", "<", ">=", "<="]), r.choice([1, 3, 12, 31, 99])
            rule = {"=": lambda x: x == v, "!=": lambda x: x != v, ">": lambda x: x is not None and x > v, "<": lambda x: x is not None and x < v, ">=": lambda x: x is not None and x >= v, "<=": lambda x: x is not None and x <= v}[op]
            return f"{c} {op} {v}", lambda row: rule(row[cols[c]])
        v = r.choice(["bay", "opal", None])
        op = r.choice(["=", "!="])
        return f"{c} {op} {v or 'null'}", lambda row: (row[cols[c]] == v) == (op == "=")

    def tree(depth):
        if not depth or r.random() < 0.3:
            return leaf()
        (x, f), (y, g), op = tree(depth - 1), tree(depth - 1), r.choice(["and", "or"])
        return f"({x}) {op} ({y})", (lambda row: f(row) and g(row)) if op == "and" else (lambda row: f(row) or g(row))

    for _ in range(12):
        text, rule = tree(3)
        assert ids(a, text) == [row[0] for row in ROWS if rule(row)], text


def test_joins(a):
    out = a.execute("select id, mark from things join marks on id = thing_id order by id, mark")
    assert out.headers == ["things.id", "marks.mark"] and out.rows() == [(1, "x"), (1, "y"), (3, "z")]
    left = a.execute("select things.id, mark from things left join marks on marks.thing_id = things.id order by id desc, mark")
    assert left.rows() == [(5, None), (4, None), (3, "z"), (2, None), (1, "x"), (1, "y")]
    assert a.execute('select id from things left join marks on id = thing_id where mark != "x" order by id').rows() == [(1,), (2,), (3,), (4,), (5,)]
    for sql, error in (
        ("select * from things join things on id = id", DialectError), ("select * from things join marks on id = label", DialectError), ("select nope from things join marks on id = thing_id", UnknownColumn),
        ("select things.id from things join texts on things.id = texts.id", TypeMismatch), ("select id from things join texts on things.label = texts.id", AmbiguousColumn),
    ):
        with pytest.raises(error):
            a.execute(sql)


def test_aggregates(a):
    out = a.execute("select count(*), count(v), count(distinct v), sum(v), avg(v), min(v), max(v), sum(distinct v) from nums")
    assert [str(x) for x in out.rows()[0]] == ["4", "3", "2", "5", "1.666667", "1", "2", "3"]
    assert out.headers[2] == "count(distinct v)"
    empty = a.execute("select count(*) as n, sum(v) as s, avg(v) as m, max(v) as x from nums where k = 99").rows()
    assert empty == [(0, None, None, None)]
    assert a.execute("select v, count(*) as n from nums group by v order by n desc, v").rows() == [(2, 2), (None, 1), (1, 1)]
    assert a.execute("select k from nums group by k having k in (2) ").rows() == [(2,)]
    assert a.execute("select k, count(*) from nums group by k having count(*) > 1").rows() == [(1, 3)]
    for sql in ("select k, v from nums group by k", "select * from nums group by k", "select sum(label) from things", "select k, count(*) as n from nums group by k having count(*) > 1"):
        with pytest.raises(DialectError):
            a.execute(sql)


def test_distinct_order_limit(a):
    assert a.execute("select distinct mass from things order by mass").rows() == [(None,), (12,), (31,), (58,)]
    assert a.execute("select spot from things order by spot desc").rows() == [("d[e",), ("cape",), ("bay",), ("bay",), (None,)]
    assert a.execute("select id as x from things order by x desc limit 2 offset 1").rows() == [(4,), (3,)]
    assert a.execute("select id from things order by mass, id offset 4").rows() == [(5,)]
    assert a.execute("select id from things limit 0").rows() == []
    assert a.execute("select id, id as again from things order by id limit 1").rows() == [(1, 1)]
    with pytest.raises(UnknownColumn):
        a.execute("select distinct spot from things order by mass")


def test_text_and_wire(a):
    out = a.execute("select id, spot from things where id lte 2 order by id")
    assert out.text() == "id\tspot\n1\tbay\n2\tnull"
    assert out.to_json()["rows"] == [[1, "bay"], [2, None]] and out.stats.rows_returned == 2 and out.count_scanned() == 5


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as v", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    a = Analytics(spark)
    a.register("t", str(tmp_path / "t"))
    plan = a.sql("select v from t where id = 5")._jdf.queryExecution().toString()
    assert "EqualNullSafe(id,5)" in plan or "EqualTo(id,5)" in plan
    assert "ReadSchema: struct<id:bigint,v:bigint>" in plan
