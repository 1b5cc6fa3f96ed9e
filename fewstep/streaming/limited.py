"""Taking the first records of a stream of files that parse, up to a number, over restarts and lost batches.

Each batch has its own counters and its own output, in folders named by the batch number. A batch that runs again, after a crash
or a restart, replaces both, so no record counts twice; the records that earlier batches wrote are read from their counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTERS = "batch long, loaded long, parsed long, written long"


def lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """value, file, start of each line of new text files of a folder. start: where the line's block of the file begins."""
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def counted(spark: SparkSession, path: str) -> DataFrame:
    """batch, loaded, parsed, written: a row for each batch that ended."""
    return spark.read.schema(COUNTERS).option("recursiveFileLookup", "true").parquet(path)


def _before(spark: SparkSession, path: str, n: int) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return 0
    return counted(spark, path).where(F.col("batch") < n).agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def take(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], limit: int, out: str, counters: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Writes the first limit records of the stream that parse() keeps, in the order of files and lines within each batch.

    parse gets value, file, place and keeps file and place; a record counts once it is kept. after(batch) is called when a
    batch's records are written and before they are counted. Ends when there are no new files.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        left = max(0, limit - _before(spark, counters, n))
        good = parse(rows.select("value", "file", F.struct("start", F.monotonically_increasing_id().alias("n")).alias("place")))
        loaded, parsed = rows.count(), good.count()
        good.orderBy("file", "place").limit(left).drop("file", "place").write.mode("overwrite").parquet(f"{out}/batch={n}")
        if after:
            after(n)
        spark.createDataFrame([(n, loaded, parsed, min(left, parsed))], COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{counters}/{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
