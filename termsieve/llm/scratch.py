"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="termsieve-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


class Scratch:
    """A folder of written tables under the shared root; a lost executor loses none of them.

    Results read them when they are asked for, so the folder goes with the application.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def _place(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back, so that later plans start from the files."""
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(target)
        if not self.names:
            fs, path = self._place()
            fs.deleteOnExit(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        fs, path = self._place(name)
        fs.delete(path, True)
        self.names.discard(name)

    def keep_only(self, *prefixes: str) -> None:
        """Delete all tables but those whose names start so."""
        for name in [n for n in self.names if not n.startswith(prefixes)]:
            self.drop(name)
