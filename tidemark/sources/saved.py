"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset on one machine
    (a local master, as in tests) a new temporary folder is made, once per session; on a cluster
    that raises, since executors could not read what others wrote there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tidemark.checkpoint.dir", named)
    return named.rstrip("/")


_SAVED: dict[str, None] = {}
_RUN: ContextVar[Run | None] = ContextVar("run", default=None)


class Run:
    """Owns the tables that this thread saves while the run is open, and may delete those alone.

    Runs nest: what an inner run has left when it closes belongs to the outer one. Another thread's
    tables are another run's, whatever the order of their writes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Run:
        self.outer = _RUN.get()
        _RUN.set(self)
        return self

    def __exit__(self, *error) -> None:
        _RUN.set(self.outer)
        if self.outer is not None:
            self.outer.paths |= self.paths

    def drop(self, *keep: DataFrame) -> int:
        """Delete this run's tables but for `keep`; their number."""
        kept = {df.saved_at for df in keep}
        gone = [path for path in self.paths if path not in kept]
        for path in gone:
            self.paths.pop(path)
            if path in _SAVED:
                _delete(self.spark, path)
        return len(gone)


def save(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of the files, not a recomputation. The
    shuffle files behind the table are of no more use then, so Spark is told to delete them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SAVED[path] = None
    if (run := _RUN.get()) is not None:
        run.paths[path] = None
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _SAVED.pop(path, None)


def discard(*saved: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for df in saved:
        _delete(df.sparkSession, df.saved_at)


def is_saved(df: DataFrame) -> bool:
    """Whether a saved table is still there."""
    return df.saved_at in _SAVED


def drop_saved(spark: SparkSession, *keep: DataFrame) -> int:
    """Delete all tables that this process has saved, but for `keep`: for its end, not for its operators."""
    kept = {df.saved_at for df in keep}
    gone = [path for path in _SAVED if path not in kept]
    for path in gone:
        _delete(spark, path)
    return len(gone)
