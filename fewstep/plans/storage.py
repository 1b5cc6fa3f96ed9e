"""Tables between plan steps: written once, reread with statistics, safe against lost executors.

Iterative plans need their lineage cut. A step's rows go to Parquet in the folder all executors share
(``spark.checkpoint.dir``), never to a machine-local folder of a cluster.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 20_000
ROWS_PER_TASK = 100_000
#: Frees a step's shuffle files when the step has been written (Spark 4.1 on; without it they wait for the driver's garbage collector).
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fewstep-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that stash() wrote."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


class Scratch:
    """Names the tables of one plan; drop() frees those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._at_exit)

    def stash(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Writes df and returns the written table.

        rows: about how many rows df has at most, if that is known; its last step then runs in a task
        per ROWS_PER_TASK of them (eight at least), however many shuffle partitions there are.
        """
        self.n += 1
        if rows is not None:
            df = df.coalesce(max(8, rows // ROWS_PER_TASK))
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(_FREES, None)
        self.spark.conf.set(_FREES, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_FREES)
            else:
                self.spark.conf.set(_FREES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stashed_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := t.__dict__.pop("_stashed_at", None):
                remove(self.spark, path)

    def _at_exit(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session has ended; its owner clears spark.checkpoint.dir
            pass


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins small by broadcast if it has at most ``rows`` rows (counted first), else by a shuffle."""
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small, on, how)
