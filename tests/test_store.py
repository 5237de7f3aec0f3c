import datetime as dt

import pytest

from lodestone import errors as e
from lodestone.session import Database


def rows(db, sql):
    return db.execute(sql).rows()


def fill(db, *statements):
    for s in statements:
        db.execute(s)


def test_rows_keep_insertion_order_and_types(db):
    fill(
        db,
        "create table t (b bool, i int, bi bigint, d decimal(10,2), v varchar(5), tx text, dt date, ts timestamp, u uuid, j json, bl blob)",
        'insert into t values (true, 1, 99999999999999999999, 1.50, "abc", "x y", 2025-01-02, "2025-01-02 03:04:05", "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "{\\"b\\":1, \\"a\\":2}", "0xFF00")',
        "insert into t values (null, null, null, null, null, null, null, null, null, null, null)",
    )
    out = db.execute("select * from t")
    first, second = out.rows()
    assert first[6] == dt.date(2025, 1, 2) and second == (None,) * 11
    assert out.text().split("\n")[1] == 'true\t1\t99999999999999999999\t1.5\tabc\tx y\t2025-01-02\t2025-01-02 03:04:05\ta0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11\t{"a":2,"b":1}\t0xFF00'
    assert out.to_json()["rows"][0][-2:] == [{"a": 2, "b": 1}, [255, 0]]
    with pytest.raises(e.TypeMismatch):  # stored tables are strict
        rows(db, "select i from t where i > 0")
    assert rows(db, "select i from t where j = \"{\\\"a\\\":2,\\\"b\\\":1}\"") == [(1,)]


def test_insert_defaults_and_keys(db):
    fill(db, 'create table t (id int primary key, name text default "anon", active bool default true, unique(name))', "insert into t values (1)", "insert into t values (2, null)", "insert into t values (3, null, false)")
    assert rows(db, "select * from t") == [(1, "anon", True), (2, None, True), (3, None, False)]
    for sql, error in (
        ("insert into t values (1, x)", e.UniqueViolation), ("insert into t values (4)", e.UniqueViolation), ("insert into t values (null)", e.NotNullViolation), ("insert into t values (a)", e.TypeMismatch),
        ("insert into t values (5, a, true, 1)", e.DialectError), ("insert into nope values (1)", e.UnknownTable),
    ):
        with pytest.raises(error):
            db.execute(sql)
    assert len(rows(db, "select id from t")) == 3
    assert db.execute("select id from t where id = 2").stats.index_used and not db.execute("select id from t where active = true").stats.index_used


def test_update_delete(db):
    fill(db, "create table t (id int primary key, v int not null, w text)", *[f"insert into t values ({i}, {i * 10}, w{i})" for i in range(1, 5)])
    assert db.execute("update t set v = 0, w = null where id >= 3").stats.rows_affected == 2
    assert rows(db, "select * from t order by id") == [(1, 10, "w1"), (2, 20, "w2"), (3, 0, None), (4, 0, None)]
    with pytest.raises(e.UniqueViolation):
        db.execute("update t set id = 9 where v = 0")
    with pytest.raises(e.NotNullViolation):
        db.execute("update t set v = null where id = 1")
    assert db.execute("delete from t where w = null").message == "deleted 2 rows"
    assert db.execute("delete from t where id = 77").stats.rows_affected == 0
    assert rows(db, "select id from t order by id") == [(1,), (2,)]


def test_schema_statements(db):
    fill(db, "create table p (a int, b int, c text, primary key(a, b))", "insert into p values (1, 1, x)", "insert into p values (1, 2, x)")
    with pytest.raises(e.UniqueViolation):
        db.execute("alter table p add unique(c)")
    fill(db, "alter table p add unique(b)", "create index on p (c, b)", "alter table p alter column c set not null", "alter table p alter column c drop not null")
    assert rows(db, "describe p") == [("a", "int", True, True, True, None, ""), ("b", "int", True, True, True, None, "c+b"), ("c", "text", False, False, False, None, "c+b")]
    for sql, error in (
        ("create table p (a int)", e.SchemaError), ("create table q (a int, a text)", e.SchemaError), ("create table q (a int primary key, b int primary key)", e.SchemaError), ("create table q (a int default x)", e.InvalidDefault),
        ("create index on p (c, b)", e.DuplicateIndex), ("drop index on p (a)", e.SchemaError), ("alter table p alter column a drop not null", e.SchemaError), ("alter table p drop unique(c)", e.SchemaError),
        ("create table q (x int, foreign key(x) references p(a))", e.SchemaError), ("create table q (x int, foreign key(x) references zz(a))", e.UnknownTable),
        ("create table q (x int not null, foreign key(x) references p(b) on delete set null)", e.SchemaError),
    ):
        with pytest.raises(error):
            db.execute(sql)
    fill(db, "drop index on p (c, b)", "alter table p drop unique(b)")


def family(db, action):
    fill(
        db, "create table p (id int primary key)", f"create table c (id int primary key, pid int, foreign key(pid) references p(id) {action})",
        "create table g (id int, cid int, foreign key(cid) references c(id) on delete cascade on update cascade)", "insert into p values (1)", "insert into p values (2)", "insert into c values (10, 1)", "insert into c values (11, null)", "insert into g values (100, 10)",
    )


def test_cascade_reaches_grandchildren(db):
    family(db, "on delete cascade on update cascade")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("insert into c values (12, 5)")
    fill(db, "update p set id = 3 where id = 1", "update c set id = 20 where id = 10")
    assert rows(db, "select * from c order by id") == [(11, None), (20, 3)] and rows(db, "select * from g") == [(100, 20)]
    db.execute("delete from p where id = 3")
    assert rows(db, "select * from c") == [(11, None)] and rows(db, "select * from g") == []


def test_set_null_and_restrict(db):
    family(db, "on delete set null on update restrict")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("update p set id = 9 where id = 1")
    fill(db, "update p set id = 8 where id = 2", "delete from p where id = 1")
    assert rows(db, "select * from c order by id") == [(10, None), (11, None)] and rows(db, "select * from g") == [(100, 10)]


def test_failed_cascade_changes_nothing(db):
    family(db, "on delete cascade")
    fill(db, "create table r (id int, gid int, foreign key(gid) references c(id))", "insert into r values (1, 10)")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("delete from p where id = 1")
    assert rows(db, "select * from p") == [(1,), (2,)] and len(rows(db, "select * from c")) == 2 and rows(db, "select * from g") == [(100, 10)]


def test_no_action_waits_for_the_end(db):
    family(db, "on delete no action on update no action")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("delete from p where id = 1")
    fill(db, "begin", "update p set id = 7 where id = 1", "update c set pid = 7 where id = 10", "commit")
    assert rows(db, "select pid from c where id = 10") == [(7,)]
    fill(db, "begin", "update p set id = 6 where id = 7")
    with pytest.raises(e.ForeignKeyViolation):
        db.execute("commit")
    assert not db.in_transaction and rows(db, "select id from p order by id") == [(2,), (7,)]


def test_transactions_and_conflicts(spark, db):
    fill(db, "create table stock (item text primary key, pieces int)", "create table prices (item text, cents int)", *[f"insert into stock values ({i}, {n})" for i, n in (("rope", 3), ("lamp", 8))], "insert into prices values (rope, 250)")
    clerk = Database(spark, db.path)
    left = "select pieces from stock where item = rope"
    fill(db, "begin", "update stock set pieces = 2 where item = rope", "insert into stock values (tent, 1)")
    assert (rows(clerk, left), rows(db, left)) == ([(3,)], [(2,)]) and len(rows(clerk, "select item from stock")) == 2
    for refused in ("begin", "create table more (a int)", "create index on stock (pieces)"):
        with pytest.raises(e.TransactionError):
            db.execute(refused)
    clerk.execute("update prices set cents = 275 where item = rope")
    db.execute("commit")
    assert rows(db, "select cents from prices") == [(275,)] and rows(clerk, left) == [(2,)]  # neither lost the other's work
    fill(db, "begin", "delete from stock where item = lamp")
    clerk.execute("update stock set pieces = 7 where item = lamp")
    with pytest.raises(e.Conflict):
        db.execute("commit")
    assert rows(db, "select * from stock order by item") == [("lamp", 7), ("rope", 2), ("tent", 1)] and not db.in_transaction
    fill(db, "begin", "delete from stock where pieces > 0", "rollback")
    assert len(rows(db, "select item from stock")) == 3
    for late in ("commit", "rollback"):
        with pytest.raises(e.TransactionError):
            db.execute(late)
    db.execute("begin")
    with pytest.raises(e.UniqueViolation):
        db.execute("insert into stock values (tent, 5)")
    assert db.in_transaction  # a failed statement leaves the transaction open


def test_reopen_insert_many_export(spark, db, tmp_path):
    fill(db, "create table t (id int primary key, d decimal(5,2), s varchar(3))")
    assert db.insert_many("t", spark.createDataFrame([(1, "1.5", "a"), (2, None, None)], "x long, y string, z string")).stats.rows_affected == 2
    for bad, error in (([(2, None, "b")], e.UniqueViolation), ([(None, None, "b")], e.NotNullViolation), ([(3, None, "long!")], e.TypeMismatch)):
        with pytest.raises(error):
            db.insert_many("t", spark.createDataFrame(bad, "x long, y string, z string"))
    db.execute("insert into t values (3, 2.25, c)")
    again = Database(spark, db.path)
    assert again.execute("select * from t order by id").text() == "id\td\ts\n1\t1.5\ta\n2\tnull\tnull\n3\t2.25\tc"
    copy = Database(spark, str(tmp_path / "copy"))
    copy.import_json(again.export_json())
    assert copy.execute("select * from t").text() == again.execute("select * from t order by id").text()
    assert copy.storage_json()["t"]["rows"] == 3 and again.checkpoint().kind == "transaction"


def test_group_and_distinct_order_of_stored_rows(db):
    fill(db, "create table t (k text, v int)", *[f"insert into t values ({k}, {v})" for k, v in (("b", 1), ("a", 2), ("b", 3), ("c", 4))])
    assert rows(db, "select k, count(*) from t group by k") == [("b", 2), ("a", 1), ("c", 1)]
    assert rows(db, "select distinct k from t limit 2") == [("b",), ("a",)]
    assert rows(db, "select v from t limit 2 offset 1") == [(2,), (3,)]


def test_broken_manifest_is_refused(spark, db):
    db.store.files.write("manifest.json", b"{")
    with pytest.raises(e.StorageError):
        Database(spark, db.path)


def test_tagged_files(db, tmp_path):
    kinds = "b bool, i int, bi bigint, d decimal(10,2), v varchar(9), tx text, dt date, ts timestamp, u uuid, j json, bl blob"
    fill(db, f"create table t ({kinds})", f"create table c ({kinds})", f"create table e ({kinds})")
    fill(
        db,
        'insert into t values (false, -1, 99999999999999999999, 1.50, "a\\\\tb", "x", 2025-01-02, "2025-01-02 03:04:05", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "{\\"a\\":2}", "0xFF00")',
        "insert into t values (null, 2, null, null, null, null, null, null, null, null, null)",
    )
    db.export_rows("t", str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines[0].split("\t") == ["@1|", "o:0", "i:-1", "g:99999999999999999999", "m:1.5", "t:a\\\\tb", "t:x", "d:2025-01-02", "s:2025-01-02 03:04:05", "u:a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", 'j:{"a":2}', "b:ff00"]
    assert lines[1].split("\t") == ["@2|", "n:", "i:2", *["n:"] * 9]
    assert db.import_rows("c", str(tmp_path / "out")).stats.rows_affected == 2
    assert rows(db, "select * from c") == rows(db, "select * from t")
    (tmp_path / "old").write_text("o:1\ti:7" + "\tn:" * 3 + "\tt:a\\tb\\nc\\\\" + "\tn:" * 5 + "\n\n")
    db.import_rows("e", str(tmp_path / "old"))
    assert rows(db, "select i, tx from e") == [(7, "a\tb\nc\\")]
    for bad in ("i:7", "o:1\tg:7" + "\tn:" * 9):
        (tmp_path / "bad").write_text(bad + "\n")
        with pytest.raises(Exception, match="values|Column 'i'"):
            db.import_rows("e", str(tmp_path / "bad"))
