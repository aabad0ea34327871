"""What several operators share: written intermediate tables, free column names and the word pattern."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that Spark hands to Python at a time, at most: a batch of long texts is held several times over on its way.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the session's checkpoint folder, or one of our own where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"


#: With this setting a query's shuffle files go when the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries begun within leave no shuffle files; the session's own setting comes back after."""
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if was is None else spark.conf.set(TIDY, was)


def materialize(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    It cuts the lineage (a lost executor costs no recomputation of what came before), and its file sizes tell the planner
    when a side is small enough to broadcast. The files go with discard(), or when the application ends; the shuffle files
    of the query that wrote them go at once.
    """
    spark = df.sparkSession
    path = scratch(spark)
    with tidy(spark):
        df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return resting(spark.read.schema(df.schema).parquet(path), path)


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, in the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def resting(df: DataFrame, *on: DataFrame | str) -> DataFrame:
    """`df`, for which discard() deletes the written tables, or paths, that it is made `on`."""
    df._tallyspark_paths = [p for x in on for p in ([x] if isinstance(x, str) else x.__dict__.get("_tallyspark_paths", []))]
    return df


def discard(*frames: DataFrame) -> None:
    """Deletes the files of what materialize() or resting() gave, once nothing will read them. Other frames have none."""
    for df in frames:
        for path in df.__dict__.get("_tallyspark_paths", []):
            place, files = _place(df.sparkSession, path)
            files.delete(place, True)
            files.cancelDeleteOnExit(place)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referred to, rather than when the driver next collects garbage."""
    for _ in range(2):  # the first makes Python let go of plans, the second finds them gone in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Keys of over HOT_ROWS rows are dealt to several tasks, HOT_TASKS at most, but for those beyond the commonest HOT_KEYS, which
#: have at most a HOT_KEYS-th of all rows each.
HOT_ROWS, HOT_TASKS, HOT_KEYS, SMALL_BYTES = 300, 500, 10_000, 1 << 18


def hot_keys(rows: DataFrame, key: str, counts: DataFrame | None = None) -> list[tuple]:
    """(key, tasks) of the common keys of `rows`, HOT_KEYS at most. `counts`: (hot, n), rows by key, where known. Tables of few
    bytes, which any join takes in one task, are not looked at."""
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return []
    counts = rows.groupBy(F.col(key).alias("hot")).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    with tidy(rows.sparkSession):
        hot = counts.filter((F.col("n") > HOT_ROWS) & F.col("hot").isNotNull()).orderBy(F.desc("n"), "hot").limit(HOT_KEYS).collect()
    return [(r.hot, min(HOT_TASKS, -(-r.n // HOT_ROWS))) for r in hot]


def join_dealt(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """`left` joined by `key` with `right`, which has one row a key. Rows of a key that is common in `left` go to several tasks,
    and its row of `right` to each of these. Null keys join nothing. `hot`: what hot_keys() says of left, where known."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    several = F.broadcast(left.sparkSession.createDataFrame(hot, f"hot {left.schema[key].dataType.simpleString()}, tasks int"))
    own = F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c, kind in left.dtypes if c != key and not kind.startswith("map")]), F.col("tasks"))).cast("int")
    a = left.join(several, F.col(key) == F.col("hot"), "left").withColumn("task", own).drop("hot", "tasks")
    b = right.join(several, F.col(key) == F.col("hot"), "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("hot", "tasks")
    return a.join(b, [key, "task"], how).drop("task")


def packed(df: DataFrame, own: dict[str, Column]) -> DataFrame:
    """All columns of `df` as one struct, `row`, beside an operator's own: whatever a table's columns are called, they clash with nothing."""
    return df.select(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.lit(0).alias("none")).alias("row"), *[c.alias(n) for n, c in own.items()])


def unpacked(names: list[str], but: list[str]) -> list[Column]:
    """The columns that packed() took, by their names, without those named as one of `but` in any case."""
    lower = {n.lower() for n in but}
    return [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in lower]


def numbered(names: list[str]) -> list[Column]:
    """Columns on their way to a Python function, which finds them by place: their names there clash with nothing."""
    return [col(c).alias(f"c{i}") for i, c in enumerate(names)]


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to ARROW_BATCH; smaller limits stay. Results do not depend on them."""
    for key, most in ARROW_BATCH.items():
        now = spark.conf.get(key, None)
        now = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for those that do not have it installed, and bounds Arrow batches."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_tallyspark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tallyspark-")  # on the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    place = Path(folder) / "tallyspark_package.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(place))
    context._tallyspark_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
