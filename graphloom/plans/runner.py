"""The stages from scripts to graphs, each a table in a run folder; finished stages are not run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import boundary, features, profile
from graphloom.parse.facts import parseable
from graphloom.sources import files

STAGES = ("scripts", "classified", "assigned", "split", "graph")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def syntax_check(done: dict[str, DataFrame]) -> DataFrame:
    """``(bundle_id, ok)``: whether the text of each bundle, put together from its modules with a comment before each, still parses."""
    text = boundary.boundary_text(done["scripts"], done["classified"], done["assigned"])
    return text.select("bundle_id", parseable()("text").alias("ok"))


def run_stages(spark: SparkSession, source: str, out: str, beautify: bool = True, until: str = "graph") -> dict[str, DataFrame]:
    """Reads the scripts below ``source`` and writes one table per stage below ``out``, up to ``until``.

    Every table that is complete is read instead of made again, so a broken run goes on where it
    stopped.  Each stage made is recorded in ``out/runs``.
    """
    if until not in STAGES:
        raise ValueError(f"unknown stage {until}")
    done: dict[str, DataFrame] = {}

    def scripts() -> DataFrame:
        rows = files.read_scripts(spark, source).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("bundle_id"), "shebang", "code")
        if not beautify:
            return rows
        return rows.join(profile.beautified(rows).select("bundle_id", "text"), "bundle_id").select("bundle_id", "shebang", F.coalesce("text", "code").alias("code"))

    def split() -> DataFrame:
        return features.split_modules(done["scripts"], boundary.module_rollup(done["classified"], done["assigned"]))

    def graph() -> DataFrame:
        edges = boundary.module_edges(boundary.statement_edges(done["classified"]), done["assigned"])
        return features.graph_modules(done["split"], edges)

    make = {"scripts": scripts, "classified": lambda: profile.classify(profile.statements_of(done["scripts"])), "assigned": lambda: boundary.assign_modules(done["classified"]), "split": split, "graph": graph}
    for number, stage in enumerate(STAGES[: STAGES.index(until) + 1]):
        path = f"{out.rstrip('/')}/{number:02d}_{stage}"
        if not _exists(spark, path):
            make[stage]().write.mode("overwrite").parquet(path)
            files.record_run(spark, f"{out.rstrip('/')}/runs", number, stage, "graphloom", [source], [path])
        done[stage] = spark.read.parquet(path)
    return done
