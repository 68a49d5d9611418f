"""Reading and writing the files around a graph; every path may be in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema

SOURCE_MAP = "sources array<string>, names array<string>, mappings string"
MANIFEST = "versions array<struct<version:string,bundle:string>>, anchor string"
RUN = "run int, stage string, tool string, timestamp string, inputs array<string>, outputs array<string>, hash_sha256 string"


def shebang(text: Column) -> Column:
    return F.when(text.startswith("#!"), F.regexp_extract(text, r"^[^\n]*\n?", 0)).otherwise("")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, shebang, code)``: one row per file."""
    text = F.col("value")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), shebang(text).alias("shebang"), F.regexp_replace(text, r"^#![^\n]*\n?", "").alias("code"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, hash_sha256)``."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("hash_sha256"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents; ``bkg_id`` is the file's path.  Raises ``ValueError`` for unsound ones."""
    graphs = spark.read.schema(schema.GRAPH).json(path, multiLine=True).withColumn("bkg_id", F.col("_metadata.file_path"))
    if bad := schema.errors(graphs).limit(20).collect():
        raise ValueError("; ".join(f"{r['bkg_id']}: {r['error']}" for r in bad))
    return graphs


def read_source_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SOURCE_MAP).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def parse_source_maps(df: DataFrame, text: str) -> DataFrame:
    """Source maps held in a column."""
    return df.withColumn("map", F.from_json(text, SOURCE_MAP))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, version, bundle)`` of a chain; raises for fewer than two versions."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("versions").alias("ord", "v")).select("ord", "v.*")
    if rows.limit(2).count() < 2:
        raise ValueError("a chain needs two versions")
    return rows


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``(path, filename, name, text)`` of a folder of module files."""
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="mod_*.js").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", file.alias("filename"), split_name(file).alias("name"), "text")


def split_name(file: Column) -> Column:
    """The name in ``mod_NNNN_<name>.js``."""
    return F.regexp_extract(file, r"^mod_[^_]*_(.*)\.js$", 1)


def find_artifact(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The first file of a folder, by name, whose name matches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    import re

    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    return next((f"{folder.rstrip('/')}/{n}" for n in names if re.search(pattern, n)), None)


def bare_stage(name: Column) -> Column:
    """A file name without its stage number and prefix."""
    return F.regexp_replace(F.regexp_replace(name, r"^\d{2}_", ""), r"^(traced|classified|beautified)-", "")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def write_graph(graphs: DataFrame, path: str) -> None:
    """One JSON document per line."""
    graphs.write.mode("errorifexists").json(path)


def write_modules(split: DataFrame, path: str, key: str = "bundle_id") -> None:
    """Module text in a folder per bundle, as ``(filename, text)`` rows in Parquet."""
    split.select(key, "filename", "text").write.partitionBy(key).parquet(path)


def write_module_files(split: DataFrame, path: str, key: str = "bundle_id") -> None:
    """One text file per module, in folders ``<bundle>/<filename>``."""
    split.select(key, F.regexp_replace("filename", r"\.js$", "").alias("module"), "text").write.partitionBy(key, "module").option("lineSep", "\n").text(path)


def next_runs(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``next_run``: one more than the highest run number, for each group; 0 where there is none."""
    return runs.groupBy(*by).agg((F.coalesce(F.max("run"), F.lit(-1)) + 1).cast("long").alias("next_run"))


def next_run(runs: DataFrame) -> int:
    """One more than the highest run number; 0 where there is none."""
    return next_runs(runs).first()[0]


def run_number(folder: Column, prefix: str = "RUN_") -> Column:
    """The number of the run folder in a path, as it is written with two digits or more."""
    return F.nullif(F.regexp_extract(folder, rf"(?:^|/){prefix}(\d+)(?:/|$)", 1), F.lit("")).cast("int")


def run_folders(inputs: DataFrame, runs: DataFrame, prefix: str = "RUN_") -> DataFrame:
    """``inputs(path)`` with ``folder, run, existing``: where the output of each input goes.

    An input that lies in a run folder stays in that run; any other gets the next run of its own folder, ``runs(base, run)``
    being the ones there.  Inputs of one folder get the same next run.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = F.nullif(F.regexp_extract(folder, rf"(?:^|/){prefix}(\d+)$", 1), F.lit("")).cast("int")
    rows = inputs.withColumns({"base": folder, "own": own}).join(next_runs(runs, ("base",)), "base", "left")
    existing = F.col("own").isNotNull()
    run = F.coalesce("own", "next_run", F.lit(0)).cast("int")
    new = F.concat("base", F.lit("/" + prefix), F.lpad(run.cast("string"), F.greatest(F.lit(2), F.length(run.cast("string"))), F.lit("0")))
    return rows.select(*inputs.columns, F.when(existing, F.col("base")).otherwise(new).alias("folder"), run.alias("run"), existing.alias("existing"))


def provenance(records: DataFrame, by: list[str], order: str = "timestamp") -> DataFrame:
    """``(*by, document)``: one JSON document per run; the only stage of a run is the document, several are its ``stages``.

    All other columns of ``records`` describe a stage; ``last_updated`` is the time of the last one.
    """
    stage = F.struct(*(c for c in records.columns if c not in by))
    runs = records.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, stage.alias("stage")))).alias("s"))
    many = F.struct(F.transform("s", lambda x: x["stage"]).alias("stages"), F.element_at("s", -1)[order].alias("last_updated"))
    return runs.select(*by, F.when(F.size("s") == 1, F.to_json(F.element_at("s", 1)["stage"])).otherwise(F.to_json(many)).alias("document"))


def record_run(spark: SparkSession, path: str, run: int, stage: str, tool: str, inputs: list[str], outputs: list[str], digest: str | None = None) -> None:
    """Appends a stage to the table of runs."""
    row = [(run, stage, tool, inputs, outputs, digest)]
    df = spark.createDataFrame(row, "run int, stage string, tool string, inputs array<string>, outputs array<string>, hash_sha256 string")
    df.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSX")).write.mode("append").parquet(path)
