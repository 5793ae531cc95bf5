"""Shared folder, joins on uneven keys and small helpers used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[Workspace] = []


@contextmanager
def freed(spark: SparkSession):
    """Queries that are written inside delete the files of their shuffles as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Workspace:
    """Tables that cut lineage, kept below ``spark.checkpoint.dir``.

    Every executor and the driver can read that folder, so a lost executor
    costs only the tasks that it ran.  The folder is read from the session; only a
    session in one process may go without, and then takes a temporary one.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="ck-")
        self.path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        _open.append(self)

    def put(self, df: DataFrame, name: str, *used: str) -> DataFrame:
        """Write ``df`` as a table of this workspace and read it back; then delete the tables ``used``, of which this was the last use.

        The files of its shuffles go once it is written, as nothing else reads them.
        """
        at = f"{self.path}/{name}"
        with freed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        for old in used:
            self.drop(old)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them; a stopped session is no error."""
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as error:  # the session may have ended before the interpreter
            if not name:
                return
            raise error
        if not name:
            atexit.unregister(self.drop)
            if self in _open:
                _open.remove(self)


class Stage:
    """Workspaces opened while a stage of a chain was planned; they go once the next stage's input no longer reads them."""

    _before: list[Workspace] = []

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def __enter__(self):
        files = self.docs.inputFiles() if Stage._before else []
        kept = [w for w in Stage._before if any(w.path.rsplit("/", 1)[1] in f for f in files)]
        for work in Stage._before:
            if work not in kept:
                work.drop()
        Stage._before = kept
        self.known = list(_open)
        return self

    def __exit__(self, *failed):
        Stage._before += [w for w in _open if w not in self.known]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def parts_of(df: DataFrame, part_bytes: int) -> int:
    """Parts of about ``part_bytes`` in which ``df`` comes, by the size of its files; 1 if no size is known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 if size >= 1 << 62 else max(1, -(-size // part_bytes))


#: Keys with over this share of all rows are joined by broadcast: at most as many of them as its inverse.
HOT_SHARE = 1e-4


def join_uneven(many: DataFrame, one: DataFrame, on: str, weight: str, least: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row per key and in ``weight`` how many rows of ``many`` hold it.

    Keys with more than ``HOT_SHARE`` of the rows (and ``least`` rows) are joined
    by broadcast; there can't be more than 1 / HOT_SHARE of them.  The rows of
    the others meet in a shuffle, where no key has more than that share.
    """
    total, most = one.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    limit = max(least, HOT_SHARE * total)
    if most <= limit:
        return many.join(one, on)
    hot = one.where(F.col(weight) > limit)
    rest = many.join(F.broadcast(hot.select(on)), on, "left_anti").join(one.where(F.col(weight) <= limit), on)
    return many.join(F.broadcast(hot), on).unionByName(rest)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
