"""Dependencies between statements and the modules that they form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.functions.text import inserted
from graphloom.operators.profile import declarator_helpers
from graphloom.sources.tables import settled


def definitions(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, name, ord)``: the last statement that defines each name."""
    return statements.select(key, "ord", F.explode("names").alias("name")).groupBy(key, "name").agg(F.max("ord").alias("ord"))


def statement_edges(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, src, dst)``: src uses a name that dst defines and src does not."""
    refs = statements.select(key, F.col("ord").alias("src"), F.explode(F.array_except("refs", "names")).alias("name"))
    found = refs.join(definitions(statements, key).withColumnRenamed("ord", "dst"), [key, "name"])
    return found.where("src <> dst").select(key, "src", "dst").distinct()


def statement_kinds(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, ord, kind)``: by the first declarator that tells; what precedes the first factory is RUNTIME."""
    d = declarator_helpers(statements, key)
    kind = F.when(F.col("own").isNotNull(), "RUNTIME").when(F.col("via") == "__commonJS", "CJS").when(F.col("via") == "__esm", "ESM").when(F.col("via").isNotNull(), "IMPORT")
    told = d.withColumn("kind", kind).where("kind is not null").groupBy(key, "ord").agg(F.min_by("kind", "place").alias("kind"))
    rows = statements.join(told, [key, "ord"], "left").withColumn("kind", F.coalesce("kind", F.lit("None")))
    first = F.min(F.when(F.col("kind").isin("CJS", "ESM"), F.col("ord"))).over(Window.partitionBy(key))
    early = (F.col("kind") == "None") & (first.isNull() | (F.col("ord") < first))
    return rows.withColumn("kind", F.when(early, "RUNTIME").otherwise(F.col("kind"))).select(key, "ord", "kind", "names", "refs", "declarators", "callee")


def anchored(kinds: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Adds ``module`` (the anchor's ord; RUNTIME statements share one, -2) where it is settled at once,
    and the final kind: statements right before an ESM factory join it, callers of factories are IMPORT."""
    order = Window.partitionBy(key).orderBy("ord")
    after = F.first(F.when(F.col("kind") != "None", F.struct("ord", "kind")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = kinds.withColumn("next", after)
    joins = (F.col("kind") == "None") & (F.col("next.kind") == "ESM")
    module = F.when(F.col("kind") == "RUNTIME", -2).when(F.col("kind").isin("CJS", "ESM"), F.col("ord")).when(joins, F.col("next.ord"))
    rows = rows.withColumn("module", module).withColumn("kind", F.when(joins, "ESM").otherwise(F.col("kind"))).drop("next")
    factories = rows.where(F.col("kind").isin("CJS", "ESM")).select(key, F.explode("names").alias("called")).distinct()
    calls = F.array_union(F.transform("declarators", lambda d: d["callee"]), F.array("callee"))
    free = rows.where("kind = 'None' and module is null").select(key, "ord", F.explode(calls).alias("called"))
    imports = free.join(factories, [key, "called"], "left_semi").select(key, "ord", F.lit(True).alias("is_import")).distinct()
    full = rows.join(imports, [key, "ord"], "left")
    return full.withColumn("kind", F.when(F.col("is_import"), "IMPORT").otherwise(F.col("kind"))).select(key, "ord", "kind", "module", "names")


def free_runs(rows: DataFrame, free: Column, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, first, last, n)``: runs of statements next to each other for which ``free`` holds."""
    upto = Window.partitionBy(key).orderBy("ord")
    runs = rows.select(key, "ord", free.alias("free"), F.count_if(~free).over(upto).alias("run")).where("free")
    return runs.groupBy(key, "run").agg(F.min("ord").cast("long").alias("first"), F.max("ord").cast("long").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def fold_runs(rows: list[tuple[int, str, int | None, list[int]]], least: float = 0.5) -> dict[int, tuple[int, str]]:
    """Clusters of the statements without a module: ``{ord: (first member, kind)}``.

    ``rows``: (ord, kind, module, statements that it uses), in order.  Within a run of such statements,
    imports and the plain statements right before them are one element; an element joins the cluster
    before it if the modules that they use overlap enough (two empty sets do).
    """
    module = {o: m for o, _, m, _ in rows}
    kind = {o: k for o, k, _, _ in rows}
    uses = {o: u for o, _, _, u in rows}
    out: dict[int, tuple[int, str]] = {}

    def mark(stmts: list[int]) -> set:
        return {module[u] for s in stmts for u in uses[s] if module.get(u) is not None}

    def settle(cluster: list[list[int]]) -> None:
        members = [o for e in cluster for o in e]
        name = "IMPORT" if any(kind[o] == "IMPORT" for o in members) else "None"
        for o in members:
            out[o] = (members[0], name)
            module[o] = members[0]

    def run_of(run: list[int]) -> None:
        elements: list[tuple[list[int], set]] = []
        k = 0
        while k < len(run):
            if kind[run[k]] != "IMPORT":
                elements.append(([run[k]], mark([run[k]])))
                k += 1
                continue
            group: list[int] = []
            while elements and all(kind[o] == "None" for o in elements[-1][0]):
                group = elements.pop()[0] + group
            while k < len(run) and kind[run[k]] == "IMPORT":
                group.append(run[k])
                k += 1
            elements.append((group, mark(group)))
        cluster, seen = [elements[0][0]], set(elements[0][1])
        for members, own in elements[1:]:
            same = len(seen & own) / len(seen | own) if seen or own else 1.0
            if same < least:
                settle(cluster)
                cluster, seen = [], set()
            cluster.append(members)
            seen |= own
        settle(cluster)

    run: list[int] = []
    for o, _, m, _ in rows:
        if m is None:
            run.append(o)
        elif run:
            run_of(run)
            run = []
    if run:
        run_of(run)
    return out


def assign_modules(statements: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, ord, kind, module_id)``; modules are numbered by their first statement.

    Everything but the fold over free statements is set-oriented; the fold gets ids only.  Written, because
    what follows reads them several times.
    """
    placed = anchored(statement_kinds(statements, key), key)
    used = statement_edges(statements, key).groupBy(key, F.col("src").alias("ord")).agg(F.collect_set("dst").alias("uses"))
    rows = placed.join(used, [key, "ord"], "left").select(key, "ord", "kind", "module", "uses")
    # a row per bundle, so that a batch holds many; dealt out, because the fold takes longer than their size lets Spark expect
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "module", "uses"))).alias("s"))
    per = per.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType([statements.schema[key], *StructType.fromDDL("ord int, kind string, module int")])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256).to_pydict(), []
                for k, stmts in zip(part[key], part["s"], strict=True):
                    found = fold_runs([(x["ord"], x["kind"], x["module"], x["uses"] or []) for x in stmts])
                    out += [{key: k, "ord": x["ord"], "kind": found[x["ord"]][1], "module": found[x["ord"]][0]} if x["ord"] in found else {key: k, "ord": x["ord"], "kind": x["kind"], "module": x["module"]} for x in stmts]
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    folded = per.mapInArrow(run, schema)
    first = folded.withColumn("first", F.min("ord").over(Window.partitionBy(key, "module")))
    numbered = first.withColumn("module_id", F.dense_rank().over(Window.partitionBy(key).orderBy("first")) - 1)
    return settled(numbered.select(key, "ord", "kind", "module_id"), "assigned")


def module_rollup(statements: DataFrame, assigned: DataFrame, key: str = "bundle_id") -> DataFrame:
    """One row per module: kind, lines, bytes, statement counts, first name, span, statement list."""
    rows = statements.join(assigned, [key, "ord"])
    name = F.when(F.size("names") > 0, F.element_at("names", 1))
    sums = rows.groupBy(key, "module_id").agg(
        F.min_by("kind", F.when(F.col("kind") == "None", 1).otherwise(0)).alias("wrapKind"), F.array_sort(F.collect_list("ord")).alias("statements"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.sum("bytes").alias("bytes"), F.sum("inner").alias("inner"), F.count(F.lit(1)).alias("n"), F.min_by(name, F.when(name.isNotNull(), F.col("ord"))).alias("first_name"), F.min("start").alias("char_start"), F.max("end").alias("char_end"),
    )
    return sums.withColumn("stmt_count", F.when(F.col("inner") > 0, F.col("inner") + F.col("n") - 1).otherwise(F.col("n")))


def module_edges(edges: DataFrame, assigned: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, src, dst)`` between different modules."""
    at = assigned.select(key, F.col("ord").alias("src"), F.col("module_id").alias("a"))
    to = assigned.select(key, F.col("ord").alias("dst"), F.col("module_id").alias("b"))
    return edges.join(at, [key, "src"]).join(to, [key, "dst"]).where("a <> b").select(key, F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def boundary_text(bundles: DataFrame, statements: DataFrame, assigned: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, text)``: the source with a comment where each module begins."""
    rows = statements.select(key, "ord", "start").join(assigned, [key, "ord"])
    first = rows.groupBy(key, "module_id").agg(F.min_by(F.struct("start", "kind"), "ord").alias("f"))
    note = F.format_string("/* --- module %d (%s) --- */\n", "module_id", "f.kind")
    per = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f.start", note.alias("note")))).alias("n"))
    return bundles.select(key, "code").join(per, key, "left").select(key, inserted()("code", "n.start", "n.note").alias("text"))
