"""Tables in the shared folder, to cut lineage between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OPEN: list["Workspace"] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (local mode, tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="massloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small(table: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a written table of at most so many rows; others are joined by shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


class Workspace:
    """Written tables of one run.

    A lost executor loses nothing that was saved here. Tables that the result still reads
    stay until the driver process ends; `drop` removes the others early.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self._saved = 0, set()
        if spark.conf.get(_ARROW_ROWS, "10000") == "10000":  # texts are long: smaller batches to Python
            spark.conf.set(_ARROW_ROWS, "1000")
        if not _OPEN:
            atexit.register(_close_all)
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        at = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(at, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(at)
        out._massloom_path = at
        self._saved.add(at)
        return out

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if at := getattr(t, "_massloom_path", None):
                self._delete(at)
                self._saved.discard(at)

    def keep(self, *tables: DataFrame) -> None:
        """Drop all tables but these."""
        stay = {getattr(t, "_massloom_path", None) for t in tables}
        for at in self._saved - stay:
            self._delete(at)
        self._saved &= stay

    def close(self) -> None:
        self._delete(self.path)


def _close_all() -> None:
    for w in _OPEN:
        try:
            w.close()
        except Exception:  # the JVM may be gone already
            return
