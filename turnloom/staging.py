"""Written intermediate tables: they cut lineage and survive the loss of any executor.

The tables go to the shared folder that the cluster names in ``spark.checkpoint.dir``. Only where that is
unset on a local master (tests, a laptop) a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, a fresh temporary one on a local master, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    key = sc.applicationId
    if key not in _runs:
        _runs[key] = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        sc.setCheckpointDir(_runs[key])
    return _runs[key]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Stage:
    """Named tables of one operator run, under one folder that is removed when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as parquet and return a scan of it (no lineage, known size)."""
        self._made += 1
        path = f"{self.root}/{self._made:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by :meth:`write` that nothing reads any more."""
        path = getattr(df, "_stage_path", None)
        if path:
            _delete(self.spark, path)

    def clear(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may be gone already at exit
            pass
