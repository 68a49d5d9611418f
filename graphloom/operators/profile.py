"""Classification of top-level statements.

``statements``: one row per statement with the fields of ``parse.facts.STATEMENT`` and ``bundle_id``.
Helper tables hold a few rows per bundle, but are joined by plain equi-joins; Spark broadcasts
them by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import inserted, numbered
from graphloom.parse.facts import parsed_statements
from graphloom.parse.layout import beautify_of
from graphloom.sources.tables import settled

LABELS = {"FunctionDeclaration": "FUNCTION_DECL", "ClassDeclaration": "CLASS_DECL", "ExpressionStatement": "EXPRESSION", "ExportNamedDeclaration": "EXPORT_NAMED", "ExportDefaultDeclaration": "EXPORT_DEFAULT", "ExportAllDeclaration": "EXPORT_ALL", "ImportDeclaration": "IMPORT", "IfStatement": "IF_STMT", "ForStatement": "FOR_STMT", "ForInStatement": "FOR_STMT", "ForOfStatement": "FOR_STMT", "WhileStatement": "WHILE_STMT", "DoWhileStatement": "WHILE_STMT", "TryStatement": "TRY_STMT", "SwitchStatement": "SWITCH_STMT", "BlockStatement": "BLOCK_STMT", "EmptyStatement": "EMPTY"}
FACTORY = {"__commonJS": "MODULE_FACTORY.__commonJS", "__esm": "MODULE_FACTORY.__esm", "__toESM": "ADAPTED_IMPORT.__toESM", "__copyProps": "REEXPORT.__copyProps"}


def _map(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def beautified(bundles: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, text, ratio)``: sources laid out, and how much longer they got; only white space changes."""
    out = bundles.select(key, "code", beautify_of()("code").alias("text"))
    return out.select(key, "text", F.round(F.try_divide(F.length("text"), F.length("code")), 2).alias("ratio"))


def statements_of(bundles: DataFrame, key: str = "bundle_id") -> DataFrame:
    """One row per top-level statement of ``bundles(bundle_id, code)``; none for text that does not parse.

    Parsed once and written, as what follows reads them several times; texts are dealt out first, because
    parsing takes far longer than their size lets Spark expect.
    """
    spread = bundles.select(key, "code").repartition(int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return settled(parsed_statements(spread, key), "statements")


def helpers(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, name, helper)``: variables that hold interop helpers; the last definition counts."""
    found = statements.select(key, "ord", F.explode("declarators").alias("d")).where("d.shape is not null")
    return found.groupBy(key, "d.name").agg(F.max_by("d.shape", F.struct("ord", "d.ord")).alias("helper"))


def bundle_type(bundles: DataFrame, statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, bundler, confidence, signals)``."""
    have = helpers(statements, key).groupBy(key).agg(F.collect_set("helper").alias("have"))
    first = statements.where("ord < 5").join(bundles.select(key, "code"), key)
    pre = F.substring("code", F.col("start") + 1, F.col("end") - F.col("start")).rlike(r"Object\.(create|defineProperty|getOwnPropertyDescriptor|getOwnPropertyNames)")
    counts = first.groupBy(key).agg(F.count_if(pre).alias("n_pre"))
    full = bundles.select(key, "code").join(have, key, "left").join(counts, key, "left")
    signals = F.array(
        *(F.when(F.array_contains("have", h), F.lit(f"{h} helper detected")) for h in FACTORY),
        F.when(F.col("n_pre") >= 3, F.lit("Object.* preamble (3+ in first 5 statements)")),
        F.when(F.col("code").contains("createRequire") & F.col("code").contains("import.meta.url"), F.lit("createRequire(import.meta.url) banner")),
    )
    out = full.select(key, F.filter(signals, lambda x: x.isNotNull()).alias("signals"))
    n = F.size("signals")
    return out.select(key, F.when(n > 0, "esbuild").otherwise("unknown").alias("bundler"), F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low").alias("confidence"), "signals")


def declarator_helpers(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Declarator rows with ``own`` (helper that it defines) and ``via`` (helper that it calls)."""
    known = helpers(statements, key)
    rows = statements.select(key, "ord", F.explode("declarators").alias("d")).select(key, "ord", F.col("d.ord").alias("place"), "d.name", "d.id_kind", "d.callee", "d.preamble")
    own = known.select(key, "name", F.col("helper").alias("own"))
    via = known.select(key, F.col("name").alias("callee"), F.col("helper").alias("via"))
    return rows.join(own, [key, "name"], "left").join(via, [key, "callee"], "left")


def classify(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Statements with ``category, wrap_kind, name``."""
    d = declarator_helpers(statements, key)
    preamble = (F.col("ord") < 10) & F.col("preamble")
    subtype = F.coalesce(F.col("own"), F.when(preamble, F.lit("preamble")))
    factory = F.when(subtype.isNull(), _map(FACTORY, F.col("via")))
    shown = F.when(F.col("id_kind") == "ObjectPattern", F.lit("{...}")).when(F.col("id_kind") == "ArrayPattern", F.lit("[...]")).when(F.col("id_kind") != "Identifier", F.lit("?"))
    shown = shown.when(F.col("own").isNotNull(), F.concat_ws(" → ", "name", "own")).when(F.col("via").isNotNull(), F.concat("name", F.lit(" (via "), "via", F.lit(")"))).otherwise(F.col("name"))
    per = d.groupBy(key, "ord").agg(
        F.array_join(F.array_sort(F.collect_set(subtype)), "+").alias("subtypes"), F.array_join(F.array_sort(F.collect_set(factory)), "+").alias("factories"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))), lambda x: x["shown"]), ", ").alias("shown"),
    )
    full = statements.join(per, [key, "ord"], "left")
    declared = F.col("type") == "VariableDeclaration"
    category = F.when(declared & (F.col("subtypes") != ""), F.concat(F.lit("RUNTIME_HELPER."), "subtypes")).when(declared & (F.col("factories") != ""), F.col("factories")).when(declared, "VAR_DECL").otherwise(F.coalesce(_map(LABELS, F.col("type")), F.upper("type")))
    out = full.withColumn("category", category).withColumn("name", F.coalesce("shown", "label"))
    return out.withColumn("wrap_kind", wrap_kind(F.col("category"))).drop("subtypes", "factories", "shown")


def wrap_kind(category: Column) -> Column:
    starts = lambda p: category.startswith(p)
    return F.when(starts("RUNTIME_HELPER"), "RUNTIME").when(starts("MODULE_FACTORY.__commonJS"), "CJS").when(starts("MODULE_FACTORY.__esm") | starts("ADAPTED_IMPORT") | starts("REEXPORT"), "ESM").otherwise("None")


def header_comment(classified: DataFrame) -> Column:
    """The comment that goes before a statement."""
    return F.format_string("/* === [%s] TYPE: %s | WRAPKIND: %s | NAME: %s | LINES: %d-%d | BYTES: %d === */", numbered(F.col("ord")), "category", "wrap_kind", "name", "line_start", "line_end", "bytes")


def annotated_text(bundles: DataFrame, classified: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, text)``: the source with a comment before each statement, gaps kept."""
    notes = classified.select(key, F.struct("start", F.concat(header_comment(classified), F.lit("\n")).alias("note")).alias("n"))
    per = notes.groupBy(key).agg(F.array_sort(F.collect_list("n")).alias("n"))
    return bundles.select(key, "code").join(per, key, "left").select(key, inserted()("code", "n.start", "n.note").alias("text"))


def byte_accounting(bundles: DataFrame, statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, statement_bytes, gap_bytes, total, balanced)``."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("ord")), F.lit(0))
    sums = statements.withColumn("gap", F.col("start") - before).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("s"), F.sum("gap").alias("g"), F.max("end").alias("last"))
    full = bundles.select(key, F.length("code").alias("total")).join(sums, key, "left")
    out = full.select(key, F.coalesce("s", F.lit(0)).alias("statement_bytes"), (F.coalesce("g", F.lit(0)) + F.col("total") - F.coalesce("last", F.lit(0))).alias("gap_bytes"), F.col("total").cast("long").alias("total"))
    return out.withColumn("balanced", F.col("statement_bytes") + F.col("gap_bytes") == F.col("total"))


def by_count(rows: DataFrame, group: str, by: list[str], order: str = "ord") -> DataFrame:
    """Count per value of ``group`` and its ``rank``, most frequent first; ties go to the value seen first."""
    n = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).drop("first")


def category_profile(rows: DataFrame, group: str, size: str, by: list[str]) -> DataFrame:
    """Count, bytes and share of bytes per value of ``group``."""
    sums = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    return sums.withColumn("pct", F.round(F.try_divide(F.col("bytes") * 100.0, F.sum("bytes").over(Window.partitionBy(*by))), 6))
