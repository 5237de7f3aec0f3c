"""One query for each operator of the dialect, over the TPC-H-like tables, with its oracle SQL.

Decimals leave as doubles on both sides, so the comparison does not depend on how decimals are rendered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scenarios
from .errors import DialectError
from .session import Analytics, Database
from .sources.scratch import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def analytics(spark: SparkSession, sf_dir: str, *tables: str) -> Analytics:
    a = Analytics(spark)
    for t in tables or TABLES:
        a.register(t, f"{sf_dir}/{t}.parquet")
    return a


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields])


MONEY = "cast({} as decimal(15,2))"
_docs = "from documents left join labels on documents.doc_id = labels.doc_id"
_odocs = "from documents d left join labels l on d.doc_id = l.doc_id"
_cust = "select c_custkey, c_name, cast(cast(c_acctbal as decimal(15,2)) as double) as c_acctbal from customer"
_bal = "cast(c_acctbal as decimal(15,2))"

FLAGSHIP = (
    'select orders.o_orderpriority as priority, count(*) as n, sum(orders.o_totalprice) as total from customer join orders on customer.c_custkey = orders.o_custkey '
    'where customer.c_mktsegment = "BUILDING" group by orders.o_orderpriority order by n desc, priority limit 3'
)

#: name: (statement, oracle)
STATEMENTS: dict[str, tuple[str, str]] = {
    "flagship_join_group": (
        FLAGSHIP,
        "select o_orderpriority as priority, count(*) as n, cast(sum(cast(o_totalprice as decimal(15,2))) as double) as total from customer join orders on c_custkey = o_custkey "
        "where c_mktsegment = 'BUILDING' group by 1 order by n desc, priority limit 3",
    ),
    # scan and projection
    "scan_all": ("select * from nation", "select * from nation"),
    "project_columns": ("select c_custkey, c_mktsegment from customer", "select c_custkey, c_mktsegment from customer"),
    "project_alias": ("select c_custkey as id, c_name as who from customer", "select c_custkey as id, c_name as who from customer"),
    "project_duplicate": ("select n_name as a, n_name as b from nation", "select n_name as a, n_name as b from nation"),
    # predicates
    "filter_eq": ('select c_custkey, c_name from customer where c_mktsegment = "BUILDING"', "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'"),
    "filter_eq_point": ("select o_orderkey, o_orderpriority from orders where o_orderkey = 7", "select o_orderkey, o_orderpriority from orders where o_orderkey = 7"),
    "filter_neq": ('select c_custkey, c_name from customer where c_mktsegment != "BUILDING"', "select c_custkey, c_name from customer where c_mktsegment is distinct from 'BUILDING'"),
    "filter_neq_words": ("select n_nationkey, n_name from nation where n_regionkey neq 1", "select n_nationkey, n_name from nation where n_regionkey <> 1"),
    "filter_gt": ("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 5000.00", f"{_cust} where {_bal} > 5000.00"),
    "filter_lt": ("select c_custkey, c_name, c_acctbal from customer where c_acctbal lt 0", f"{_cust} where {_bal} < 0"),
    "filter_gte": ("select o_orderkey from orders where o_custkey >= 100", "select o_orderkey from orders where o_custkey >= 100"),
    "filter_lte": ("select o_orderkey from orders where o_custkey lte 100", "select o_orderkey from orders where o_custkey <= 100"),
    "filter_in": ("select n_name from nation where n_nationkey in (1, 3, 5, 99)", "select n_name from nation where n_nationkey in (1, 3, 5, 99)"),
    "filter_in_null": (f"select documents.doc_id as doc_id, labels.quality as quality {_docs} where labels.quality in (1, null)", f"select d.doc_id, l.quality {_odocs} where l.quality = 1 or l.quality is null"),
    "filter_like_prefix": ('select p_partkey, p_name from part where p_name like "a*"', "select p_partkey, p_name from part where starts_with(p_name, 'a')"),
    "filter_like_suffix": ('select p_partkey, p_name from part where p_name like "*e"', "select p_partkey, p_name from part where ends_with(p_name, 'e')"),
    "filter_like_infix": ('select p_partkey, p_type from part where p_type like "*A*"', "select p_partkey, p_type from part where contains(p_type, 'A')"),
    "filter_like_single": ('select p_partkey, p_brand from part where p_brand like "Brand#?1"', "select p_partkey, p_brand from part where p_brand like 'Brand#_1'"),
    "filter_like_mixed": ('select c_custkey, c_mktsegment from customer where c_mktsegment like "?U*E"', "select c_custkey, c_mktsegment from customer where c_mktsegment like '_U%E'"),
    "filter_and": (
        'select o_orderkey from orders where o_orderstatus = "O" and o_custkey < 50', "select o_orderkey from orders where o_orderstatus = 'O' and o_custkey < 50"
    ),
    "filter_or": ("select n_name from nation where n_regionkey = 1 or n_nationkey = 0", "select n_name from nation where n_regionkey = 1 or n_nationkey = 0"),
    "filter_parens": (
        'select o_orderkey from orders where (o_custkey < 20 and o_orderstatus = "O") or o_orderpriority = "1-URGENT"',
        "select o_orderkey from orders where (o_custkey < 20 and o_orderstatus = 'O') or o_orderpriority = '1-URGENT'",
    ),
    "filter_is_null": (f"select documents.doc_id as doc_id {_docs} where labels.toxic is null", f"select d.doc_id {_odocs} where l.toxic is null"),
    "filter_is_not_null": (f"select documents.doc_id as doc_id, labels.toxic as toxic {_docs} where labels.toxic is not null", f"select d.doc_id, l.toxic {_odocs} where l.toxic is not null"),
    "filter_eq_null": (f"select documents.doc_id as doc_id {_docs} where labels.quality = null", f"select d.doc_id {_odocs} where l.quality is null"),
    "filter_neq_with_nulls": (f"select documents.doc_id as doc_id, labels.quality as quality {_docs} where labels.quality != 1", f"select d.doc_id, l.quality {_odocs} where l.quality is distinct from 1"),
    "filter_range_over_nulls": (f"select documents.doc_id as doc_id {_docs} where labels.quality >= 0", f"select d.doc_id {_odocs} where l.quality >= 0"),
    "filter_timestamp_range": (
        'select o_orderkey from orders where o_orderdate >= "1995-01-01 00:00:00" and o_orderdate < "1996-01-01 00:00:00"',
        "select o_orderkey from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'",
    ),
    "filter_decimal_range": (
        "select l_orderkey, l_linenumber from lineitem where l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24",
        "select l_orderkey, l_linenumber from lineitem where cast(l_discount as decimal(15,2)) between 0.05 and 0.07 and cast(l_quantity as decimal(15,2)) < 24",
    ),
    # joins
    "join_inner": (
        "select nation.n_name as nation, region.r_name as region from nation join region on nation.n_regionkey = region.r_regionkey",
        "select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey",
    ),
    "join_inner_filter": (
        'select customer.c_custkey as c_custkey, nation.n_name as n_name from customer join nation on nation.n_nationkey = customer.c_nationkey where customer.c_mktsegment = "MACHINERY"',
        "select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey where c_mktsegment = 'MACHINERY'",
    ),
    "join_inner_one_to_many": (
        "select orders.o_orderkey as o_orderkey, lineitem.l_linenumber as l_linenumber from orders join lineitem on orders.o_orderkey = lineitem.l_orderkey where orders.o_custkey < 300",
        "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where o_custkey < 300",
    ),
    "join_left": (f"select documents.doc_id as doc_id, documents.lang as lang, labels.quality as quality {_docs}", f"select d.doc_id, d.lang, l.quality {_odocs}"),
    "join_left_filter_right": (f"select documents.doc_id as doc_id {_docs} where labels.toxic = 1", f"select d.doc_id {_odocs} where l.toxic = 1"),
    "join_unqualified": (
        "select n_name as n_name, r_name as r_name from nation join region on n_regionkey = r_regionkey where r_name != \"ASIA\"",
        "select n_name, r_name from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA'",
    ),
    # aggregates
    "agg_count_star": ("select count(*) as n from lineitem", "select count(*) as n from lineitem"),
    "agg_count_col_nulls": (f"select count(*) as n, count(labels.quality) as labelled {_docs}", f"select count(*) as n, count(l.quality) as labelled {_odocs}"),
    "agg_count_distinct": ("select count(distinct o_custkey) as customers from orders", "select count(distinct o_custkey) as customers from orders"),
    "agg_sum_int": ("select sum(p_size) as total from part", "select cast(sum(p_size) as bigint) as total from part"),
    "agg_sum_decimal": ("select sum(o_totalprice) as total from orders", "select cast(sum(cast(o_totalprice as decimal(15,2))) as double) as total from orders"),
    "agg_sum_distinct": ("select sum(distinct p_size) as total from part", "select cast(sum(distinct p_size) as bigint) as total from part"),
    "agg_avg_int": (
        "select p_brand, avg(p_size) as mean from part group by p_brand", "select p_brand, round(cast(sum(p_size) as double) / count(p_size), 6) as mean from part group by 1"
    ),
    "agg_avg_decimal": (
        "select c_mktsegment, avg(c_acctbal) as mean from customer group by c_mktsegment",
        f"select c_mktsegment, round(cast(sum({_bal}) as double) / count({_bal}), 6) as mean from customer group by 1",
    ),
    "agg_avg_distinct": ("select avg(distinct p_size) as mean from part", "select round(cast(sum(distinct p_size) as double) / count(distinct p_size), 6) as mean from part"),
    "agg_min_max_text": ("select min(c_name) as lo, max(c_name) as hi from customer", "select min(c_name) as lo, max(c_name) as hi from customer"),
    "agg_min_max_timestamp": ("select min(o_orderdate) as lo, max(o_orderdate) as hi from orders", "select min(o_orderdate) as lo, max(o_orderdate) as hi from orders"),
    "agg_global_empty": (
        "select count(*) as n, sum(o_custkey) as total, min(o_orderstatus) as lo from orders where o_orderkey < 0",
        "select count(*) as n, cast(sum(o_custkey) as bigint) as total, min(o_orderstatus) as lo from orders where o_orderkey < 0",
    ),
    "group_by_one": ("select o_orderstatus, count(*) as n from orders group by o_orderstatus", "select o_orderstatus, count(*) as n from orders group by 1"),
    "group_by_many": (
        "select l_returnflag, l_linestatus, sum(l_quantity) as qty, sum(l_extendedprice) as price, count(*) as n from lineitem group by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(15,2))) as double) as qty, cast(sum(cast(l_extendedprice as decimal(15,2))) as double) as price, count(*) as n from lineitem group by 1, 2",
    ),
    "group_by_null_key": (f"select labels.quality as quality, count(*) as n {_docs} group by labels.quality", f"select l.quality, count(*) as n {_odocs} group by 1"),
    "group_no_agg": ("select c_nationkey from customer group by c_nationkey", "select c_nationkey from customer group by 1"),
    "group_count_distinct": ("select event_type, count(distinct user_id) as users from events group by event_type", "select event_type, count(distinct user_id) as users from events group by 1"),
    "having_count": ("select o_custkey, count(*) from orders group by o_custkey having count(*) > 15", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 15"),
    "having_distinct": (
        "select c_nationkey, count(distinct c_mktsegment), sum(c_custkey) from customer group by c_nationkey having count(distinct c_mktsegment) >= 5 and sum(c_custkey) > 100",
        "select c_nationkey, count(distinct c_mktsegment) as segments, cast(sum(c_custkey) as bigint) as total from customer group by 1 having count(distinct c_mktsegment) >= 5 and sum(c_custkey) > 100",
    ),
    "having_alias": (
        "select c_mktsegment, sum(c_acctbal) as total from customer group by c_mktsegment having total > 1000000.00 and (total < 9000000.00 or c_mktsegment = \"BUILDING\")",
        f"select c_mktsegment, cast(sum({_bal}) as double) as total from customer group by 1 having sum({_bal}) > 1000000 and (sum({_bal}) < 9000000 or c_mktsegment = 'BUILDING')",
    ),
    "having_in": (
        'select o_orderpriority, count(*) as n from orders group by o_orderpriority having o_orderpriority in ("1-URGENT", "2-HIGH")',
        "select o_orderpriority, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1",
    ),
    "join_group": (
        "select region.r_name as region, count(*) as nations from nation join region on nation.n_regionkey = region.r_regionkey group by region.r_name",
        "select r_name as region, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1",
    ),
    "join_left_group": (
        f"select documents.lang as lang, count(*) as n, count(labels.toxic) as labelled, sum(labels.toxic) as toxic {_docs} group by documents.lang",
        f"select d.lang, count(*) as n, count(l.toxic) as labelled, cast(sum(l.toxic) as bigint) as toxic {_odocs} group by 1",
    ),
    # distinct, order, limit
    "distinct_one": ("select distinct c_mktsegment from customer", "select distinct c_mktsegment from customer"),
    "distinct_many": ("select distinct o_orderstatus, o_orderpriority from orders", "select distinct o_orderstatus, o_orderpriority from orders"),
    "distinct_nulls": (f"select distinct labels.quality as quality {_docs}", f"select distinct l.quality {_odocs}"),
    "distinct_order": (
        "select distinct o_orderstatus, o_orderpriority from orders order by o_orderpriority desc, o_orderstatus limit 7",
        "select distinct o_orderstatus, o_orderpriority from orders order by o_orderpriority desc, o_orderstatus limit 7",
    ),
    "distinct_grouped": ("select distinct count(*) as n from orders group by o_custkey", "select distinct n from (select count(*) as n from orders group by o_custkey)"),
    "order_multi": (
        "select c_custkey, c_mktsegment from customer order by c_mktsegment desc, c_custkey limit 20", "select c_custkey, c_mktsegment from customer order by c_mktsegment desc, c_custkey limit 20"
    ),
    "order_desc": ("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10", "select o_orderkey from orders order by cast(o_totalprice as decimal(15,2)) desc, o_orderkey limit 10"),
    "order_nulls": (
        f"select documents.doc_id as doc_id, labels.quality as quality {_docs} order by labels.quality, documents.doc_id limit 25",
        f"select d.doc_id, l.quality {_odocs} order by l.quality nulls first, d.doc_id limit 25",
    ),
    "order_nulls_desc": (
        f"select documents.doc_id as doc_id, labels.quality as quality {_docs} order by labels.quality desc, documents.doc_id limit 25",
        f"select d.doc_id, l.quality {_odocs} order by l.quality desc nulls last, d.doc_id limit 25",
    ),
    "order_alias": ("select c_custkey as id from customer order by id desc limit 5", "select c_custkey as id from customer order by id desc limit 5"),
    "order_agg": (
        "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 10", "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 10"
    ),
    "limit": ("select n_name from nation order by n_nationkey limit 7", "select n_name from nation order by n_nationkey limit 7"),
    "offset": ("select n_name from nation order by n_nationkey offset 20", "select n_name from nation order by n_nationkey offset 20"),
    "limit_offset": ("select n_name from nation order by n_nationkey limit 5 offset 3", "select n_name from nation order by n_nationkey limit 5 offset 3"),
    "limit_zero": ("select n_name from nation limit 0", "select n_name from nation limit 0"),
}


#: Headers of aggregates are no handy names for columns; these results get others.
NAMES = {"having_count": ("o_custkey", "n"), "having_distinct": ("c_nationkey", "segments", "total")}


def _query(statement: str, names: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    words = set(statement.replace(",", " ").split())
    tables = [t for t in TABLES if t in words]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = analytics(spark, sf_dir, *tables).sql(statement)
        return plain(out.toDF(*names) if names else out)

    return run


def agg_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types and exact values of sums and means, as text."""
    sql = "select sum(o_totalprice) as a, avg(o_totalprice) as b, sum(o_custkey) as c, avg(o_custkey) as d, count(*) as e, min(o_totalprice) as f from orders"
    df = analytics(spark, sf_dir, "orders").sql(sql)
    return df.select(*[F.concat(F.typeof(c), F.lit(" "), F.col(c).cast("string")).alias(c) for c in df.columns])


_cents = "cast(round(o_totalprice * 100) as hugeint)"
_mean = "(({0} * 2000000 + {1}) // (2 * {1}))"  # whole-number arithmetic: millionths, rounded half up
AGG_TYPES = f"""with x as (select sum({_cents}) as s, sum(o_custkey)::hugeint as k, count(*)::hugeint as n, min({_cents}) as m from orders),
  y as (select *, {_mean.format("s", "(n * 100)")} as ms, {_mean.format("k", "n")} as mk from x)
  select 'decimal(38,2) ' || (s // 100) || '.' || lpad((s % 100)::varchar, 2, '0') as a, 'decimal(38,6) ' || (ms // 1000000) || '.' || lpad((ms % 1000000)::varchar, 6, '0') as b,
  'bigint ' || k as c, 'decimal(38,6) ' || (mk // 1000000) || '.' || lpad((mk % 1000000)::varchar, 6, '0') as d, 'bigint ' || n as e,
  'decimal(15,2) ' || (m // 100) || '.' || lpad((m % 100)::varchar, 2, '0') as f from y"""


# -- statements that write: each runs in a new scratch database filled from the tables, and returns what is stored after it

_NATION = 'create table nation (n_nationkey int primary key, n_name text not null, n_regionkey int default 0, unique(n_name))'
_REGION = "create table region (r_regionkey int primary key, r_name text)"


def _filled(spark: SparkSession, sf_dir: str, foreign_key: str = "") -> Database:
    db = Database(spark, scratch_path(spark))
    db.execute(_REGION)
    db.insert_many("region", spark.read.parquet(f"{sf_dir}/region.parquet"))
    db.execute(_NATION[:-1] + (f", foreign key(n_regionkey) references region(r_regionkey) {foreign_key})" if foreign_key else ")"))
    db.insert_many("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return db


def _refused(db: Database, statement: str) -> None:
    try:
        db.execute(statement)
    except DialectError:
        return
    raise AssertionError(f"The engine took: {statement}")


def _written(foreign_key: str, statements: list[str], result: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _filled(spark, sf_dir, foreign_key)
        for s in statements:
            if s.startswith("! "):
                _refused(db, s[2:])
            else:
                db.execute(s)
        return plain(db.execute(result).frame())

    return run


_ALL = "select n_nationkey, n_name, n_regionkey from nation"
_JOINED = "select nation.n_nationkey as n_nationkey, region.r_name as r_name from nation left join region on nation.n_regionkey = region.r_regionkey"

_FK = "foreign key(n_regionkey) references region(r_regionkey)"

#: name: (foreign key of nation, statements, final query, oracle); statements after a '!' must be refused
WRITES: dict[str, tuple[str, list[str], str, str | None]] = {
    "insert_default": (
        "", ['insert into nation values (100, "ATLANTIS")', 'insert into nation values (101, "LEMURIA", null)'], _ALL,
        "select n_nationkey, n_name, n_regionkey from nation union all select 100, 'ATLANTIS', 0 union all select 101, 'LEMURIA', null",
    ),
    "update_where": (
        "", ['update nation set n_regionkey = 9 where n_name like "I*" or n_regionkey = 1'], _ALL,
        "select n_nationkey, n_name, case when starts_with(n_name, 'I') or n_regionkey = 1 then 9 else n_regionkey end as n_regionkey from nation",
    ),
    "delete_where": ("", ["delete from nation where n_regionkey in (1, 2)"], _ALL, "select * from nation where n_regionkey not in (1, 2)"),
    "cascade_delete": ("on delete cascade", ["delete from region where r_regionkey = 1"], _ALL, "select * from nation where n_regionkey <> 1"),
    "set_null_delete": (
        "on delete set null", ["delete from region where r_regionkey = 1"], _ALL, "select n_nationkey, n_name, nullif(n_regionkey, 1) as n_regionkey from nation",
    ),
    "cascade_update": (
        "on update cascade", ["update region set r_regionkey = 77 where r_regionkey = 2"], _JOINED,
        "select n_nationkey, r_name from nation left join region on n_regionkey = r_regionkey",
    ),
    "set_null_update": (
        "on update set null", ["update region set r_regionkey = 77 where r_regionkey = 2"], _JOINED,
        "select n_nationkey, r_name from nation left join region on n_regionkey = r_regionkey and r_regionkey <> 2",
    ),
    "transaction_commit": (
        "", ["begin", "delete from nation where n_regionkey = 0", 'update nation set n_name = "X" where n_nationkey = 1', 'update nation set n_regionkey = 5 where n_nationkey = 2', "commit"], _ALL,
        "select n_nationkey, case when n_nationkey = 1 then 'X' else n_name end as n_name, case when n_nationkey = 2 then 5 else n_regionkey end as n_regionkey from nation where n_regionkey <> 0",
    ),
    "transaction_rollback": ("", ["begin", "delete from nation where n_regionkey = 0", "rollback"], _ALL, "select * from nation"),
    "no_action_deferred": (
        "on update no action on delete no action",
        ["begin", "update region set r_regionkey = 77 where r_regionkey = 2", "update nation set n_regionkey = 77 where n_regionkey = 2", "commit"], _ALL,
        "select n_nationkey, n_name, case when n_regionkey = 2 then 77 else n_regionkey end as n_regionkey from nation",
    ),
    "alter_and_index": (
        "", ["alter table region add unique(r_name)", "alter table nation add foreign key(n_regionkey) references region(r_regionkey)", "create index on nation (n_regionkey)", "alter table nation alter column n_regionkey set not null"],
        "select n_nationkey, n_name from nation where n_regionkey = 3", "select n_nationkey, n_name from nation where n_regionkey = 3",
    ),
    "restrict_delete": ("on delete restrict", ["! delete from region where r_regionkey = 1", "delete from nation where n_regionkey = 2", "delete from region where r_regionkey = 2"], "select * from region", "select * from region where r_regionkey <> 2"),
    "restrict_update": (
        "on update restrict", ["! update region set r_regionkey = 77 where r_regionkey = 2", 'update region set r_name = "X" where r_regionkey = 2'], "select * from region",
        "select r_regionkey, case when r_regionkey = 2 then 'X' else r_name end as r_name from region",
    ),
    "foreign_key_check": (
        "on delete cascade", ['! insert into nation values (200, "X", 99)', 'insert into nation values (201, "Y", 3)', 'insert into nation values (202, "Z", null)', "! update nation set n_regionkey = 50 where n_nationkey = 3"], _ALL,
        "select * from nation union all select 201, 'Y', 3 union all select 202, 'Z', null",
    ),
    "unique_check": (
        "", ['! insert into nation values (7, "X")', '! insert into nation values (300, "NATION_3")', '! update nation set n_name = "NATION_3" where n_nationkey = 0', "! update nation set n_nationkey = 500 where n_regionkey = 1", "update nation set n_nationkey = 500 where n_nationkey = 6"], _ALL,
        "select case when n_nationkey = 6 then 500 else n_nationkey end as n_nationkey, n_name, n_regionkey from nation",
    ),
    "not_null_check": ("", ["! insert into nation values (400, null)", "! update nation set n_name = null where n_nationkey = 1", "alter table nation alter column n_name drop not null", "update nation set n_name = null where n_nationkey = 1"], _ALL, "select n_nationkey, case when n_nationkey <> 1 then n_name end as n_name, n_regionkey from nation"),
    "drop_unique": ("", ["alter table nation drop unique(n_name)", 'update nation set n_name = "SAME" where n_regionkey = 1'], _ALL, "select n_nationkey, case when n_regionkey = 1 then 'SAME' else n_name end as n_name, n_regionkey from nation"),
    "drop_foreign_key": (
        "on delete restrict", ["! delete from region where r_regionkey = 1", f"alter table nation drop {_FK}", "delete from region where r_regionkey = 1", 'insert into nation values (200, "X", 99)'],
        "select nation.n_nationkey as n_nationkey, region.r_name as r_name from nation left join region on nation.n_regionkey = region.r_regionkey",
        "select n_nationkey, case when r_regionkey <> 1 then r_name end as r_name from (select * from nation union all select 200, 'X', 99) left join region on n_regionkey = r_regionkey",
    ),
    "alter_refused": (
        "", ["! alter table nation add unique(n_regionkey)", "update nation set n_regionkey = null where n_nationkey = 1", "! alter table nation alter column n_regionkey set not null", "update region set r_regionkey = 9 where r_regionkey = 0", f"! alter table nation add {_FK}"],
        "describe nation",
        "select * from (values ('n_nationkey','int',true,true,true,null,''), ('n_name','text',false,true,true,null,''), ('n_regionkey','int',false,false,false,'0','')) t(\"column\", \"type\", primary_key, \"unique\", not_null, \"default\", indexes)",
    ),
    "index_lookup": ("", ["create index on nation (n_regionkey)", 'insert into nation values (700, "N", 3)', "drop index on nation (n_regionkey)", "create index on nation (n_name, n_regionkey)", "create index on nation (n_regionkey)"], f"{_ALL} where n_regionkey = 3", "select * from nation where n_regionkey = 3 union all select 700, 'N', 3"),
    "key_lookup": ("", ['insert into nation values (800, "N", 3)'], f"{_ALL} where n_nationkey = 800", "select 800 as n_nationkey, 'N' as n_name, 3 as n_regionkey"),
    "unique_lookup": ("", ['insert into nation values (800, "N", 3)'], f'{_ALL} where n_name = "NATION_4"', "select * from nation where n_name = 'NATION_4'"),
    "ddl_in_transaction": ("", ["begin", "! create index on nation (n_regionkey)", "! create table x (a int)", "delete from nation where n_regionkey = 0", "commit"], _ALL, "select * from nation where n_regionkey <> 0"),
    "failed_statement": ("", ["begin", 'insert into nation values (600, "P")', '! insert into nation values (600, "Q")', "! begin", 'update nation set n_name = "R" where n_nationkey = 600', "commit"], _ALL, "select * from nation union all select 600, 'R', 0"),
    "no_action_refused": (
        "on update no action on delete no action", ["! delete from region where r_regionkey = 1", "! update region set r_regionkey = 77 where r_regionkey = 2", "begin", "delete from region where r_regionkey = 3", "! commit", "delete from nation where n_regionkey = 4", "delete from region where r_regionkey = 4"],
        _JOINED, "select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where r_regionkey <> 4",
    ),
    "stored_order": ("", ["update nation set n_regionkey = null where n_nationkey = 5", 'insert into nation values (900, "A", 2)'], f"{_ALL} order by n_regionkey desc limit 6 offset 9", "select n_nationkey, n_name, n_regionkey from (select n_nationkey, n_name, case when n_nationkey <> 5 then n_regionkey end as n_regionkey, n_nationkey as rid from nation union all select 900, 'A', 2, 1000) order by n_regionkey desc nulls last, rid limit 6 offset 9"),
    "describe": (
        "", ["create index on nation (n_regionkey, n_name)"], "describe nation",
        "select * from (values ('n_nationkey','int',true,true,true,null,''), ('n_name','text',false,true,true,null,'n_regionkey+n_name'), ('n_regionkey','int',false,false,false,'0','n_regionkey+n_name')) t(\"column\", \"type\", primary_key, \"unique\", not_null, \"default\", indexes)",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _query(statement, NAMES.get(name, ())) for name, (statement, _) in STATEMENTS.items()} | {"agg_types": agg_types}
    out |= {name: _written(fk, statements, result) for name, (fk, statements, result, _) in WRITES.items()}
    return out | scenarios.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in STATEMENTS.items()} | {"agg_types": AGG_TYPES} | {name: sql for name, (*_, sql) in WRITES.items() if sql} | scenarios.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(FLAGSHIP)(spark, sf_dir)
