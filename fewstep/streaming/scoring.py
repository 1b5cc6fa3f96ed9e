"""An extension: recipes that arrive as NDJSON files are parsed and scored against a fixed corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fewstep.functions import text as tx
from fewstep.sources.records import RECORD


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """recipe_id, feat: the heads of the recipes in new files of a folder."""
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("input IS NOT NULL")
    heads = F.array_distinct(F.array_compact(F.transform(tx.split_sections("input")["ingredients"], lambda x: tx.head(tx.clean_line(x)))))
    return rows.select(tx.recipe_id("input", "id", "_id", "recipe_id").alias("recipe"), F.explode(heads).alias("feat"))


def recall_of(targets: DataFrame, corpus: DataFrame, weights: DataFrame) -> DataFrame:
    """t, s, recall of the targets' heads in the corpus (recipe, feat), by fixed weights (feat, w)."""
    t = targets.select(F.col("recipe").alias("t"), "feat").join(weights.select("feat", "w"), "feat")
    total = t.groupBy("t").agg(F.sum("w").alias("total"))
    common = t.join(corpus.select(F.col("recipe").alias("s"), "feat"), "feat").groupBy("t", "s").agg(F.sum("w").alias("common"))
    return common.join(total, "t").select("t", "s", F.round(F.col("common") / F.col("total"), 6).alias("recall"))


def start(stream: DataFrame, corpus: DataFrame, weights: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores each batch of new recipes; sink gets its rows and the batch number. Ends when nothing is new."""

    def batch(rows: DataFrame, n: int) -> None:
        sink(recall_of(rows.distinct(), corpus, weights), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
