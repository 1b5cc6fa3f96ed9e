"""Readers and writers: NDJSON in its variants, JSON documents, vocabularies, vectors, CSV and ranked results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fewstep.functions import text as tx

RECORD = "input string, id string, _id string, recipe_id string"
RESULT = (
    "query_id string, query_title string, results array<struct<other_id string, other_title string, pzt_score double, pzt_edit_score double,"
    " switch_cost double, edit_cost double, in_pzt_zone boolean, explanations struct<missing_heads_top array<struct<id int, w double>>,"
    " extra_heads_top array<struct<id int, w double>>, missing_ops_top array<struct<id int, w double>>, extra_ops_top array<struct<id int, w double>>>>>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), value: the physical lines of the files, in file and byte order.

    A block of a file stands in one partition in order, so the blocks' counts give every line its number
    without sorting the lines; there are as many counts as blocks.
    """
    block = ["_file", "_start"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy(*block).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*block, (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(F.broadcast(blocks), block).select((F.col("_at") + F.col("_shift")).alias("line_no"), "value")


def read_ndjson(spark: SparkSession, path: str, limit: int | None = None, physical: bool = False) -> DataFrame:
    """line_no and the record's fields of the lines that parse; malformed ones are skipped.

    limit counts parsed records, or physical lines. A record without input has the empty one.
    """
    lines = numbered_lines(spark, path)
    if limit and physical:
        lines = lines.where(F.col("line_no") <= limit)
    bad = f"{RECORD}, _bad string"
    parsed = lines.select("line_no", F.from_json("value", bad, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    parsed = parsed.where("r IS NOT NULL AND r._bad IS NULL").join(lines.where("trim(value) <> ''").select("line_no"), "line_no", "left_semi")
    out = parsed.select("line_no", F.coalesce("r.input", F.lit("")).alias("input"), "r.id", "r._id", "r.recipe_id")
    return out.orderBy("line_no").limit(limit) if limit and not physical else out


def canonical(records: DataFrame) -> DataFrame:
    """Records of read_ndjson() as recipes: id, title, section lines, warnings, heads and techniques."""
    sections = records.withColumn("_s", tx.split_sections("input")).withColumn("warnings", tx.missing_sections("input"))
    heads = F.sort_array(F.array_distinct(F.array_compact(F.transform("_s.ingredients", lambda x: tx.head(tx.clean_line(x))))))
    return sections.select(
        tx.recipe_id("input", "id", "_id", "recipe_id").alias("recipe_id"), F.col("_s.title").alias("title"), F.col("_s.ingredients").alias("ingredients"),
        F.transform("_s.instructions", tx.clean_line).alias("instructions"), F.col("input").alias("full_text"), "warnings", F.col("line_no").alias("source_line_number"),
        heads.alias("heads"), tx.techniques(F.array_join("_s.instructions", " ")).alias("techniques"),
    )


def read_strict(spark: SparkSession, path: str, skip_bad: bool = False) -> tuple[DataFrame, DataFrame]:
    """Recipes, and the audit of records that miss a section. Without skip_bad the recipes fail on one."""
    recipes = canonical(read_ndjson(spark, path))
    audit = recipes.where(F.size("warnings") > 0).select("recipe_id", "source_line_number", "warnings")
    good = recipes.where(F.size("warnings") == 0)
    if not skip_bad:
        said = F.concat(F.lit("line "), F.col("source_line_number").cast("string"), F.lit(", recipe "), F.col("recipe_id"), F.lit(": no "), F.array_join("warnings", ", "))
        good = recipes.where(F.when(F.size("warnings") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    return good, audit


def json_to_ndjson(spark: SparkSession, source: str, target: str) -> None:
    """A JSON array (or JSON lines) as one object a line."""
    spark.read.option("multiLine", True).json(source).write.json(target)


def read_results(spark: SparkSession, path: str, which: str = "all", k: int = 1) -> DataFrame:
    """Ranked results, a row each: all, the first of a query, its first k, or of the last record of a query."""
    lines = numbered_lines(spark, path).select("line_no", F.from_json("value", RESULT).alias("r")).where("r IS NOT NULL").select("line_no", "r.*")
    if which == "last":
        lines = lines.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("line_no")))).where("_n = 1").drop("_n")
    rows = lines.select("line_no", "query_id", "query_title", F.posexplode("results").alias("place", "result"))
    if which in ("first", "top"):
        rows = rows.where(F.col("place") < (1 if which == "first" else k))
    score = F.coalesce("result.pzt_score", "result.pzt_edit_score", F.lit(0.0)).alias("score")
    return rows.select("line_no", "query_id", "query_title", "place", score, "result.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of a JSON map; an empty map gives no rows."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,int>").alias("m"))
    return rows.select(F.explode("m").alias("token", "id"))


def read_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with a header: the named columns as doubles, null where they are no numbers or NaN."""
    rows = spark.read.option("header", True).csv(path)
    for c in numbers:
        x = F.col(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double")
        rows = rows.withColumn(c, F.when(~F.isnan(x), x))
    return rows


def optional(read, spark: SparkSession, path: str | None) -> DataFrame | None:
    """What read gives, or None where no path is given or nothing is there."""
    if not path:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(spark, path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def read_positions(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """position (from 0) and the entry of a JSON array of strings in one file, such as titles or ids."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("x"))
    return text.select(F.posexplode("x").alias("position", name))


def with_names(rows: DataFrame, column: str, names: DataFrame | None, name: str, missing: str | None = None) -> DataFrame:
    """rows with the entry at the position that a column holds; without an entry, or without names, missing, or the position itself."""
    other = F.lit(missing) if missing is not None else F.col(column).cast("string")
    if names is None:
        return rows.withColumn(name, other)
    at = names.select(F.col("position").alias("_at"), F.col(name).alias("_name"))
    return rows.join(at, F.col(column) == F.col("_at"), "left").withColumn(name, F.coalesce("_name", other)).drop("_at", "_name")


def write_csv(rows: DataFrame, path: str, k: int | None = None, order: list | None = None) -> bool:
    """A CSV with a header, of the first k rows in an order if given; nothing is written without rows."""
    if order:
        rows = rows.orderBy(*order)
    if k is not None:
        rows = rows.limit(k)
    if rows.isEmpty():
        return False
    rows.write.option("header", True).csv(path)
    return True


def write_matrix(pairs: DataFrame, path: str) -> None:
    """i, j, sim as rows of a CSV without a header, in order of i and j."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "sim"))), lambda x: x["sim"].cast("string")), ",")
    pairs.groupBy("i").agg(row.alias("value")).orderBy("i").select("value").write.text(path)


def write_results(nested: DataFrame, flat: DataFrame, path: str) -> None:
    """Ranked results as JSON lines and as a flat CSV."""
    nested.write.json(f"{path}/results.jsonl")
    flat.write.option("header", True).csv(f"{path}/results.csv")


def write_rankings(targets: DataFrame, sources: DataFrame, audit: DataFrame | None, path: str) -> None:
    """Both directions of a run, each (t or s, the other, rank, costs) as JSON lines with nested results and as a flat CSV, and the audit as JSON lines."""
    from fewstep.operators.rank import nested

    for name, rows, by, other in (("targets_to_sources", targets, "t", "s"), ("sources_to_targets", sources, "s", "t")):
        nested(rows, by, other).write.json(f"{path}/{name}.jsonl")
        rows.orderBy(by, "rank").write.option("header", True).csv(f"{path}/{name}.csv")
    if audit is not None:
        audit.write.json(f"{path}/parse_audit.json")


def write_summary(summary: DataFrame, key: str, path: str) -> None:
    """One JSON object: of each value of key the row's other columns, by name; columns without a value are left out."""
    rest = F.struct(*[c for c in summary.columns if c != key])
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), rest.alias("value"))))
    summary.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)


def write_enriched(rows: DataFrame, said: str, path: str, by: str = "t", other: str = "s") -> None:
    """Ranked rows (by, other, rank, costs) with a text for each: as JSON lines with nested results, and as a flat CSV of ids and texts."""
    from fewstep.operators.rank import nested

    nested(rows, by, other).write.json(f"{path}/results.jsonl")
    flat = rows.orderBy(by, "rank").select(F.col(by).alias("query_id"), F.col(other).alias("other_id"), said)
    flat.write.option("header", True).option("escape", '"').csv(f"{path}/texts.csv")


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)


def write_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name."""
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")
