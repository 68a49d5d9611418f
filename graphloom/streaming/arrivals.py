"""Graphs of scripts as they arrive in a folder: a file stream, one idempotent table per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.features import bundle_graph
from graphloom.sources.files import shebang


def arriving_scripts(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """``(bundle_id, shebang, code)`` of each new file."""
    text = F.col("value")
    rows = spark.readStream.option("maxFilesPerTrigger", max_files).option("wholetext", True).text(folder)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("bundle_id"), shebang(text).alias("shebang"), F.regexp_replace(text, r"^#![^\n]*\n?", "").alias("code"))


def keep_graphs(scripts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the modules of every batch to ``out/batch=<id>``; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        bundle_graph(batch.select("bundle_id", "code")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return scripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
