"""What the operators share: exact column choice, reading a table, checkpoints, row keys."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their Python need not find it by itself."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact spelling; others, whatever their names, are dropped."""
    ship(df.sparkSession)
    cols = df.columns
    for n in names:
        if n not in cols:
            raise ValueError(f"missing column {n!r}; there are {cols}")
    numbered = df.toDF(*[f"c{i}__" for i in range(len(cols))])
    return numbered.select(*[F.col(f"c{cols.index(n)}__").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names (all executors share it). Where that is unset and all of Spark is one
    process, as in tests, a temporary folder; on a cluster, an error."""
    context = spark.sparkContext
    where = context._jsc.sc().getCheckpointDir()
    if where.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        where = context._jsc.sc().getCheckpointDir()
    return where.get()


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and cut from its lineage, as a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> str:
    """The path of `df` as Parquet in the shared folder; for rows that a checkpoint, which compresses nothing, would store at length."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: a writer holds one in memory
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what `written` wrote, when nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    time.sleep(1)  # the cleaner works beside us; what comes next should find the room free


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def bound(value: Column, use) -> Column:
    """`use(v)`, where `value` is computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_key(*cols: str) -> Column:
    """128 bits that name a row by its content: equal rows have equal keys, nulls are their own value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\u0000", *parts).cast("binary")))


def by_size(items, sizes, limit):
    """Runs of `items` whose `sizes` sum to `limit` at most, or single larger ones."""
    out, total = [], 0
    for x, n in zip(items, sizes):
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(x)
        total += n
    if out:
        yield out
