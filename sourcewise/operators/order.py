"""Ranks and running values over a whole table, without a task that reads it all.

Rows are dealt out by ranges of the order and numbered within each partition; one
small row per partition (its count, its total, its greatest value) is scanned on the
driver, and its result is brought back to the rows of the next partitions.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a session in one process may go without, and takes a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="order-"))
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession):
    """Plans that are made and run inside delete the files of their shuffles as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, which keeps its partitioning; the files of its shuffles go once it is written."""
    _shared(df.sparkSession)
    with _freed(df.sparkSession):
        return df.select("*").checkpoint()


class Tables:
    """Tables of one query as compressed files in the checkpoint folder.

    The files of a table's shuffles go once it is written, and a table once it has had its
    last use.  A table's size is that of its files: a checkpoint keeps the estimate of its
    plan, which a round that joins a table with itself squares, until the number itself
    takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{_shared(spark)}/tables-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, *used: DataFrame) -> DataFrame:
        """``df``, written and read back; then the tables ``used``, of which this was the last use, are deleted."""
        at = f"{self.path}/{self.n}"
        self.n += 1
        with _freed(self.spark):
            df.write.option("compression", "zstd").parquet(at)
        self.drop(*used)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._place = at
        return out

    def drop(self, *used: DataFrame) -> None:
        for old in used:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(old._place)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, groups: int, *keys) -> DataFrame:
    """``df`` in parts by key for about ``groups`` groups of long work on few bytes, which Spark would join into few tasks by their size."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(groups, max(tasks, groups // 8))), *keys)


class Ordered:
    """A table in the order of some columns, ties in the order of the later ones."""

    def __init__(self, df: DataFrame, *order):
        self.order = order
        self.rows = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))

    def running(self, **values: tuple[str, Column]) -> Ordered:
        """With a column for each name: the running ("sum" or "max", value), the own row included."""
        local = Window.partitionBy("_part").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        kinds = {"sum": F.sum, "max": F.max}
        each = self.rows.select("*", *(kinds[how](v).over(local).alias(name) for name, (how, v) in values.items()))
        parts = self.rows.groupBy("_part").agg(*(kinds[how](v).alias(name) for name, (how, v) in values.items())).orderBy("_part").collect()
        scanned, so_far = [], [None] * len(values)
        for part in parts:
            scanned.append((part["_part"], *so_far))
            for k, (name, (how, _)) in enumerate(values.items()):
                x = part[name]
                if x is not None:
                    so_far[k] = x if so_far[k] is None else so_far[k] + x if how == "sum" else max(so_far[k], x)
        spark: SparkSession = self.rows.sparkSession
        fields = dict(each.dtypes)
        schema = ", ".join(["_part int", *(f"_before_{name} {fields[name]}" for name in values)])
        both = each.join(F.broadcast(spark.createDataFrame(scanned, schema)), "_part", "left")
        for name, (how, _) in values.items():
            before = F.col(f"_before_{name}")
            total = F.coalesce(F.col(name) + before, F.col(name), before) if how == "sum" else F.greatest(name, before)
            both = both.withColumn(name, total).drop(f"_before_{name}")
        out = object.__new__(Ordered)
        out.order, out.rows = self.order, both
        return out

    def numbered(self, name: str = "i") -> Ordered:
        """With the place of each row, from 0 on."""
        out = self.running(**{name: ("sum", F.lit(1).cast("bigint"))})
        out.rows = out.rows.withColumn(name, F.col(name) - 1)
        return out

    @property
    def frame(self) -> DataFrame:
        return self.rows.drop("_part")


def numbered(df: DataFrame, *order, name: str = "i") -> DataFrame:
    """``df`` with the place of each row in an order, from 0 on."""
    return Ordered(df, *order).numbered(name).frame


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``df`` with the rank of ``value`` from 1 on, ties sharing their mean; nulls have none.

    Distinct values are ranked by their counts, so a value that many rows share is one row of the order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Ordered(counts, value).running(_upto=("sum", F.col("_n"))).frame
    return df.join(upto.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), value, "left")


def permutation_folds(df: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: keys in an order drawn by a digest of seed and key, dealt in turn, so folds differ by one row at most."""
    drawn = df.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return numbered(drawn, "_draw", key, name="_i").withColumn("fold", (F.col("_i") % folds).cast("int")).drop("_draw", "_i")
