"""Sources and sinks: labelled vectors, requests, evaluation sets, responses and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neargrid.functions.features import quantised_columns
from neargrid.sources.schemas import EVALUATION, REFERENCE
from neargrid.sources.shared import materialise


#: Tables of fewer files than cores are dealt out anew if they have fewer bytes a core.
SMALL = 32 << 20


def spread_out(df: DataFrame) -> DataFrame:
    """A small table of a few files, which few tasks would read, over all cores: rows may cost much more than their bytes tell."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of files with their number from 0: by file name, then by place in the file, however files are packed into tasks."""
    part = ["_file", "_block"]
    placed = materialise(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")))
    parts = placed.groupBy(*part).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part of a file
    parts = parts.withColumn("_before", before)
    return placed.join(F.broadcast(parts), part).withColumn(name, F.col("_before") + F.col("_row") - F.col("_first")).drop(*part, "_row", "_first", "_n", "_before")


def read_references(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{vector, label} -> ref_id, v0..v13, label (1: fraud). Rows with another label or length fail.

    One JSON array a file, which one task reads; with `lines` one object a line, which is the way for large files.
    ref_id is the row's place by file name and place in the file.
    """
    raw = numbered(spark.read.schema(REFERENCE).option("multiLine", not lines).json(path), "ref_id")
    ok = F.col("label").isin("legit", "fraud") & (F.size("vector") == 14)
    checked = raw.select("ref_id", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.lit("a reference needs 14 numbers and a label legit or fraud"))).alias("vector"), "label")
    return checked.select("ref_id", *quantised_columns("vector"), (F.col("label") == "fraud").cast("tinyint").alias("label"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of request JSON -> body."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body")


def read_evaluation(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{entries: [{request, expected_approved}]} -> body, expected_approved; with `lines` one entry a line."""
    if lines:
        rows = spark.read.schema(EVALUATION["entries"].dataType.elementType).json(path).select(F.struct("request", "expected_approved").alias("e"))
    else:
        rows = spark.read.schema(EVALUATION).option("multiLine", True).json(path).select(F.explode("entries").alias("e"))
    return rows.select(F.col("e.request").alias("body"), "e.expected_approved")


def warm(df: DataFrame) -> DataFrame:
    """Cache and touch every row."""
    df.cache().count()
    return df


def write_responses(decisions: DataFrame, path: str) -> None:
    decisions.select("fraud_score", "approved").write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def ready(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(True).alias("ready"))
