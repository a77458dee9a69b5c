"""Steps written to a folder that the driver and all executors share, and their removal."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of spark.checkpoint.dir; where it is unset, one in the warehouse.

    A warehouse on the driver's own disk serves a local master alone; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        master = spark.sparkContext.master
        if base.startswith(("file:", "/")) and not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {base} is the driver's own")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str, table: str | None = None) -> None:
    sc = spark.sparkContext
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Staged folders that no block of `temporaries` holds: they go when Python ends, since frames given to a caller may still read them.
_LASTING: list[tuple] = []
#: The folders of this thread's blocks, the innermost last.
_BLOCKS: ContextVar[tuple[list, ...]] = ContextVar("blocks", default=())


@atexit.register
def _sweep() -> None:
    while _LASTING:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(*_LASTING.pop())


@contextlib.contextmanager
def temporaries():
    """What `staged` writes inside is deleted at the end, except where it is told to keep it: that then belongs to the block outside.

    What leaves the block has to be staged with keep=True, as its files are read later."""
    own: list[tuple] = []
    token = _BLOCKS.set((*_BLOCKS.get(), own))
    try:
        yield
    finally:
        _BLOCKS.reset(token)
        for one in own:
            _delete(*one)


def claimed(spark: SparkSession, keep: bool = False, table: str | None = None) -> str:
    """A new path in the shared folder, which goes (with the table of that name) when the block ends, or with keep the one outside."""
    blocks = _BLOCKS.get()
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    holders = [_LASTING, *blocks]
    holders[-2 if keep and blocks else -1].append((spark, path, table))
    return path


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = claimed(spark, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: object):
    """A session setting for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
