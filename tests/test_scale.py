"""What statements must not do as tables grow: their plans, and what they write."""

import os
import re
import shutil
import subprocess
import sys

import pytest

from lodestone import errors as e
from lodestone.session import Analytics, Database

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def a(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "t")
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as int) as k", "if(id % 10 = 0, null, concat('n#', id)) as s", "id / 8 as d", "cast(id / 4 as float) as f", "timestamp_seconds(id * 3600) as ts", "if(id % 3 = 0, null, id) as v")
    df.repartition(2).write.parquet(path)
    out = Analytics(spark)
    out.register("t", path)
    out.register("u", path)
    return out


@pytest.mark.parametrize(
    "where,pushed",
    [
        ("id = 5", "EqualNullSafe(id,5)"), ("id != 5", "Not(EqualNullSafe(id,5))"), ("k > 3", "GreaterThan(k,3)"), ("v <= 9", "LessThanOrEqual(v,9)"), ("id in (1, 2, 3)", "In(id"), ("v in (1, null)", "IsNull(v)"), ("v = null", "IsNull(v)"),
        ('s like "n#1*"', "StringStartsWith(s,n#1)"), ('s like "n#?5"', "StringStartsWith(s,n#)"), ('s like "*99"', "StringEndsWith(s,99)"), ("d >= 2.5", "GreaterThanOrEqual(d,2.49)"), ("d = 2.5", "LessThanOrEqual(d,2.51)"), ("f < 3", "LessThanOrEqual(f,3.01)"),
        ('ts < "1970-01-02 00:00:00"', "LessThanOrEqual(ts,"), ("v > 5 or v = null", "Or(GreaterThan(v,5),IsNull(v))"), ("k = 1 and v >= 5", "GreaterThanOrEqual(v,5)"),
    ],
)
def test_conditions_reach_the_scan(spark, a, where, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = a.sql(f"select id from t where {where}")
    scans = re.findall(r"PushedFilters: (\[.*?\]), ReadSchema", plan(df))
    assert pushed in scans[0]
    # the same rows as without anything to push to
    plain = Analytics(spark)
    plain.register_frame("t", spark.createDataFrame(a.table("t").df.collect(), a.table("t").df.schema))
    assert sorted(df.collect()) == sorted(plain.sql(f"select id from t where {where}").collect())


def test_rounded_columns(a):
    """3 / 8 is 0.375, which counts as 0.38: the wider test on the file's column keeps it."""
    got = lambda where: sorted(r[0] for r in a.execute(f"select id from t where {where}").rows())
    assert got("d = 0.38") == [3] and got("d > 0.37 and d < 0.39") == [3] and got("d in (0.38, 0.50)") == [3, 4] and got("d <= 0.13") == [0, 1]
    assert sorted(a.execute("select t.id from t join u on t.id = u.id where t.d <= 0.13 and u.d > 0.05").rows()) == [(1,)]
    assert len(a.execute("select t.id from t left join u on t.id = u.id where u.d > 0.05 or t.id = 0").rows()) == 1000


def test_frames_are_not_sorted(spark, db):
    db.execute("create table t (k int, v int)")
    db.insert_many("t", spark.range(20).selectExpr("id % 3", "id"))
    for sql in ("select * from t", "select k, count(*) from t group by k", "select distinct k from t", "select v from t where k = 1"):
        assert "Sort [" not in plan(db.execute(sql).frame()), sql
    assert "Sort [" in plan(db.execute("select v from t order by k").frame()) or "TakeOrdered" in plan(db.execute("select v from t order by k").frame())
    assert db.execute("select v from t limit 3").frame().collect() == [(0,), (1,), (2,)]
    assert [r[0] for r in db.execute("select v from t").rows()] == list(range(20))
    assert db.execute("select v from t").stats.rows_scanned is None and len(db.execute("select k from t where v > 3").text().split("\n")) == 17


def files_of(db, name):
    table = db.store.head().tables[name]
    return {f for s in table.segments for f in (db.store._files(s) if s.count("/") == 1 else [s])}


def test_a_change_rewrites_only_its_files(spark, db):
    db.execute("create table t (id int primary key, v int)")
    db.insert_many("t", spark.range(0, 800, 1, 8).selectExpr("id", "id * 2"))
    before = files_of(db, "t")
    assert len(before) == 8
    assert db.execute("update t set v = -1 where id = 5").stats.rows_affected == 1
    after = files_of(db, "t")
    assert len(before & after) == 7
    assert db.execute("delete from t where id >= 790").stats.rows_affected == 10
    assert len(before & files_of(db, "t")) == 6
    assert Database(spark, db.path).execute("select count(*) from t").rows() == [(790,)] and db.execute("select v from t where id = 5").rows() == [(-1,)]
    db.execute("delete from t where id >= 0")
    assert not before & files_of(db, "t") and db.execute("select * from t").rows() == []
    assert [r[0] for r in Database(spark, db.path).execute("select * from t").rows()] == []


def test_small_segments_are_put_together(spark, db, monkeypatch):
    from lodestone.sources import store

    monkeypatch.setattr(store, "MOST_SEGMENTS", 4)
    db.execute("create table t (id int primary key)")
    for i in range(9):
        db.execute(f"insert into t values ({i})")
    assert len(db.store.head().tables["t"].segments) <= 5 and [r[0] for r in db.execute("select id from t").rows()] == list(range(9))


def test_keys_are_checked_against_new_rows_only(spark, db):
    db.execute("create table t (a int, b int, c int, primary key(a, b), unique(c))")
    db.insert_many("t", spark.range(50).selectExpr("id", "id % 5", "if(id % 2 = 0, null, id)"))
    for bad in ([(3, 3, None)], [(100, 1, 7)], [(100, 1, None), (100, 1, None)], [(100, 1, 900), (101, 1, 900)]):
        with pytest.raises(e.UniqueViolation):
            db.insert_many("t", spark.createDataFrame(bad, "a long, b long, c long"))
    for bad in ("update t set a = 1, b = 1 where c = 3", "update t set c = 9 where a < 3", "update t set c = 5 where a = 0"):
        with pytest.raises(e.UniqueViolation):
            db.execute(bad)
    assert db.execute("update t set c = 3 where c = 3").stats.rows_affected == 1  # a row is no duplicate of itself
    assert db.insert_many("t", spark.createDataFrame([(3, 4, None), (100, 1, 901)], "a long, b long, c long")).stats.rows_affected == 2


def test_no_action_is_checked_where_something_changed(spark, db, monkeypatch):
    from lodestone.operators import constraints

    for s in ("create table p (id int primary key, v int)", "create table c (id int, pid int, foreign key(pid) references p(id) on delete no action on update no action)", "create table other (id int)"):
        db.execute(s)
    db.insert_many("p", spark.range(10).selectExpr("id", "0"))
    db.insert_many("c", spark.range(10).selectExpr("id", "id"))
    asked = []
    real = constraints.referenced
    monkeypatch.setattr(constraints, "referenced", lambda *args: asked.append(1) or real(*args))
    db.execute("insert into other values (1)")
    assert not asked
    db.execute("update p set v = 1 where id = 3")  # the key comes back with the rewritten row
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("delete from p where id = 3")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("update p set id = 30 where id = 3")
    db.execute("delete from c where pid = 3")
    db.execute("delete from p where id = 3")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("update c set pid = 3 where id = 1")
    for s in ("begin", "delete from p where id = 4", 'insert into p values (4, 9)', "commit", "begin", "delete from p where id = 5", "delete from c where pid = 5", "commit"):
        db.execute(s)
    assert len(db.execute("select id from p").rows()) == 8 and len(db.execute("select id from c").rows()) == 8


def test_an_index_reaches_old_files(spark, db):
    db.execute("create table t (id int primary key, k int, s text)")
    db.insert_many("t", spark.range(100).selectExpr("id", "id % 9", "concat('x', id)"))
    old = files_of(db, "t")
    db.execute("create index on t (k)")
    assert not old & files_of(db, "t")
    assert len(db.execute("select id from t where k = 4").rows()) == 11
    out = db.execute("select id from t where k = 4")
    out.rows()
    assert out.stats.index_used and out.stats.rows_scanned == 11
    db.execute("drop index on t (k)")
    out = db.execute("select id from t where k = 4")
    out.rows()
    assert not out.stats.index_used and out.stats.rows_scanned == 100


def test_foreign_keys_come_and_go(db):
    for s in ("create table p (id int primary key)", "create table c (id int, pid int)", "insert into p values (1)", "insert into c values (1, 1)", "alter table c add foreign key(pid) references p(id)"):
        db.execute(s)
    for refused, error in (("insert into c values (2, 5)", e.ForeignKeyViolation), ("delete from p where id = 1", e.ForeignKeyViolation), ("alter table c add foreign key(pid) references p(id)", e.SchemaError), ("alter table c drop foreign key(id) references p(id)", e.SchemaError)):
        with pytest.raises(error):
            db.execute(refused)
    db.execute("alter table c drop foreign key(pid) references p(id)")
    for s in ("insert into c values (2, 5)", "delete from p where id = 1"):
        db.execute(s)
    with pytest.raises(e.ForeignKeyViolation):  # and the old state stays
        db.execute("alter table c add foreign key(pid) references p(id)")
    assert db.execute("select * from c order by id").rows() == [(1, 1), (2, 5)] and not db.catalog_json()["c"]["foreign_keys"]


def test_scratch_needs_a_shared_folder():
    """Off this machine no temporary folder will do."""
    from lodestone.sources import scratch

    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(e.StorageError):
        scratch.scratch_path(Fake)
    Fake.sparkContext.master = "local[2]"
    assert scratch.scratch_path(Fake)


def test_entry_without_the_optional_parts(tmp_path):
    """The package, its entry and the dialect's queries do without the training-data operators."""
    for name in ("lodestone", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and not any(x.startswith('op') for x in q if x[2:3].isdigit()) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr
