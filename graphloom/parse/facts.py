"""Facts about source text as columns: one parse per text, in Arrow batches.

Every function takes a string column; texts that do not parse give nulls or empty arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.parse.js import Node, ParseError, line_of, line_starts, parse, parses, pattern_names, units, utf16, walk

KNOWN_HELPERS = ("__commonJS", "__esm", "__toESM", "__copyProps")
PREAMBLE = ("create", "defineProperty", "getOwnPropertyDescriptor", "getOwnPropertyNames", "getPrototypeOf")
TOKENS = {"FunctionDeclaration": "FD", "FunctionExpression": "FE", "ArrowFunctionExpression": "AF", "ClassDeclaration": "CD", "ClassExpression": "CE", "IfStatement": "IF", "ForStatement": "FOR", "ForInStatement": "FIN", "ForOfStatement": "FOF", "WhileStatement": "WH", "SwitchStatement": "SW", "TryStatement": "TRY", "ReturnStatement": "RET", "ThrowStatement": "THR", "YieldExpression": "YLD", "AwaitExpression": "AWT", "NewExpression": "NEW"}

DECLARATOR = "struct<ord:int,id_kind:string,name:string,init_kind:string,callee:string,preamble:boolean,shape:string>"
STATEMENT = f"struct<ord:int,type:string,start:int,end:int,bytes:int,line_start:int,line_end:int,label:string,names:array<string>,declarators:array<{DECLARATOR}>,callee:string,inner:int,refs:array<string>>"


def _init_shape(code: str, init: Node) -> str | None:
    """Which interop helper a declarator's value looks like."""
    src = code[init.start : init.end]
    if init.type == "ArrowFunctionExpression" and len(init.params) == 2 and init.body.type == "ArrowFunctionExpression" and not init.body.params:
        inner = re.sub(r"\s+", "", code[init.body.start : init.body.end])
        if "exports" in inner and "{}" in inner:
            return "__commonJS"
        if "=0" in inner and "exports" not in inner:
            return "__esm"
    if init.type in ("ArrowFunctionExpression", "FunctionExpression"):
        if "esModule" in src:
            return "__toESM"
        if "getOwnPropertyNames" in src and "defineProperty" in src:
            return "__copyProps"
    return None


def _is_object(node: Node, name: str) -> bool:
    return node.type == "Identifier" and node.name == name


def _preamble(init: Node) -> bool:
    """``Object.create`` and the like, or ``Object.prototype.hasOwnProperty``."""
    if init.type != "MemberExpression" or init.property.type != "Identifier":
        return False
    o, name = init.object, init.property.name
    if _is_object(o, "Object"):
        return name in PREAMBLE
    return o.type == "MemberExpression" and _is_object(o.object, "Object") and _is_object(o.property, "prototype") and name == "hasOwnProperty"


def _callee(node: Node | None) -> str | None:
    return node.callee.name if node is not None and node.type == "CallExpression" and node.callee.type == "Identifier" else None


def _declarators(code: str, node: Node) -> list[dict]:
    out = []
    for k, d in enumerate(node.declarations):
        named = d.id.type == "Identifier"
        shape = None
        if named and d.init is not None:
            shape = d.id.name if d.id.name in KNOWN_HELPERS else _init_shape(code, d.init)
        out.append({"ord": k, "id_kind": d.id.type, "name": d.id.name if named else None, "init_kind": d.init.type if d.init is not None else None, "callee": _callee(d.init), "preamble": d.init is not None and _preamble(d.init), "shape": shape})
    return out


def _defined(node: Node) -> list[str]:
    if node.type == "VariableDeclaration":
        return [n for d in node.declarations for n in pattern_names(d.id)]
    if node.type in ("FunctionDeclaration", "ClassDeclaration"):
        return [node.id.name] if node.id is not None else []
    if node.type == "ExportNamedDeclaration" and node.declaration is not None:
        return _defined(node.declaration)
    return []


def _label(node: Node) -> str:
    if node.type in ("FunctionDeclaration", "ClassDeclaration") and node.id is not None:
        return node.id.name
    if node.type == "ExportNamedDeclaration" and node.declaration is not None:
        return _label(node.declaration)
    if node.type == "ExportDefaultDeclaration":
        own = node.declaration.get("id")
        return own.name if own is not None else "default"
    if node.type == "VariableDeclaration":
        return ", ".join(d.id.name if d.id.type == "Identifier" else "{...}" if d.id.type == "ObjectPattern" else "[...]" for d in node.declarations)
    return "-"


def _inner(node: Node) -> int:
    """Statements inside the bodies of a declaration's factory calls."""
    total = 0
    for d in node.declarations if node.type == "VariableDeclaration" else ():
        if d.init is None or d.init.type != "CallExpression" or not d.init.arguments:
            continue
        arg = d.init.arguments[0]
        functions = [arg] if arg.type in ("ArrowFunctionExpression", "FunctionExpression") else [p.value for p in arg.properties if p.type == "Property" and p.value.type in ("ArrowFunctionExpression", "FunctionExpression")] if arg.type == "ObjectExpression" else []
        for f in functions:
            if f.body.type == "BlockStatement":
                total += sum(len(n.body) for n, *_ in walk(f.body) if n.type == "BlockStatement")
    return total


def statements(code: str | None) -> list[dict] | None:
    """Top-level statements of a text; None if it does not parse."""
    code = code or ""
    try:
        program = parse(code)
    except ParseError:
        return None
    starts, wide, out = line_starts(code), utf16(code), []
    for k, node in enumerate(program.body):
        declared = node.type == "VariableDeclaration"
        refs = list(dict.fromkeys(n.name for n, _, _, target in walk(node) if n.type == "Identifier" and not target))
        out.append({
            "ord": k, "type": node.type, "start": node.start, "end": node.end, "bytes": units(wide, node.start, node.end), "line_start": line_of(starts, node.start), "line_end": line_of(starts, max(node.start, node.end - 1)),
            "label": _label(node), "names": _defined(node), "declarators": _declarators(code, node) if declared else [], "callee": _callee(node.expression) if node.type == "ExpressionStatement" else None, "inner": _inner(node), "refs": refs,
        })
    return out


def features(code: str | None) -> dict:
    """String inventory and structural fingerprint of a text; no strings and null if it does not parse."""
    try:
        program = parse(code or "")
    except ParseError:
        return {"strings": [], "fingerprint": None}
    strings, tokens = set(), []
    for node, *_ in walk(program):
        if node.type in TOKENS:
            tokens.append(TOKENS[node.type])
        elif node.type == "Literal" and isinstance(node.value, str):
            if 2 <= len(node.value) + sum(c > "￿" for c in node.value) <= 200:
                strings.add(node.value)
        elif node.type == "TemplateLiteral":
            strings.update(q.cooked for q in node.quasis if len(q.cooked) >= 2)
    return {"strings": sorted(strings, key=lambda s: s.encode("utf-16-be", "surrogatepass")), "fingerprint": ":".join(tokens)}


DECLARES = {("VariableDeclarator", "id"), ("FunctionDeclaration", "id"), ("ClassDeclaration", "id")}


def bindings(code: str | None) -> list[dict] | None:
    """Identifier occurrences ``(name, start, end, role)``; ``role`` is declaration or reference."""
    try:
        program = parse(code or "")
    except ParseError:
        return None
    out = [{"name": n.name, "start": n.start, "end": n.end, "role": "declaration" if parent is not None and (parent.type, field) in DECLARES else "reference"} for n, parent, field, _ in walk(program) if n.type == "Identifier"]
    for node in program.body:
        if node.type == "ImportDeclaration":
            out += [{"name": s.local.name, "start": s.local.start, "end": s.local.end, "role": "declaration"} for s in node.specifiers]
    return out


def declarations(code: str | None) -> list[dict] | None:
    """Names of declarators and functions in walk order: ``(ord, kind, name)``."""
    try:
        program = parse(code or "")
    except ParseError:
        return None
    found = []
    for n, *_ in walk(program):
        if n.type == "VariableDeclarator" and n.id.type == "Identifier":
            found.append(("var", n.id.name))
        elif n.type in ("FunctionDeclaration", "ClassDeclaration") and n.id is not None:
            found.append(("fn" if n.type[0] == "F" else "class", n.id.name))
    return [{"ord": k, "kind": kind, "name": name} for k, (kind, name) in enumerate(found)]


FUNCTIONS = frozenset(("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"))


def scopes(code: str | None) -> list[list[str]] | None:
    """The variables of each scope in order of appearance; scopes are the script, functions and blocks."""
    try:
        program = parse(code or "")
    except ParseError:
        return None
    out: list[list[str]] = []

    def add(names: list[str], to: list[str]) -> None:
        to.extend(n for n in names if n not in to)

    def visit(node: Node, fn: list[str], block: list[str]) -> None:
        if node.type == "VariableDeclaration":
            for d in node.declarations:
                add(pattern_names(d.id), fn if node.kind == "var" else block)
        elif node.type in ("FunctionDeclaration", "ClassDeclaration") and node.id is not None:
            add([node.id.name], block)
        elif node.type == "ImportDeclaration":
            add([s.local.name for s in node.specifiers], block)
        own_fn, own = fn, block
        if node.type in FUNCTIONS:
            own_fn = own = []
            out.append(own)
            for p in node.params:
                add(pattern_names(p.left if p.type == "AssignmentPattern" else p), own)
        elif node.type in ("BlockStatement", "ForStatement", "ForInStatement", "ForOfStatement", "CatchClause", "SwitchStatement"):
            own = []
            out.append(own)
            if node.type == "CatchClause":
                add(pattern_names(node.param), own)
        for field, x in node.children():
            if node.type in FUNCTIONS and field == "body" and x.type == "BlockStatement":
                for _, y in x.children():
                    visit(y, own_fn, own)
            else:
                visit(x, own_fn, own)

    top: list[str] = []
    out.append(top)
    try:
        visit(program, top, top)
    except RecursionError:
        return None
    return out


def _column(f, kind: str):
    @F.pandas_udf(kind)
    def run(code: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in code], dtype=object)

    return run


def parsed_statements(bundles: DataFrame, key: str, at_once: int = 256) -> DataFrame:
    """One row per statement of ``bundles(key, code)``; Python holds the statements of ``at_once`` texts at most."""
    schema = StructType([bundles.schema[key], *StructType.fromDDL(STATEMENT[len("struct<") : -1])])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once).to_pydict()
                yield pa.RecordBatch.from_pylist([{key: k, **x} for k, code in zip(part[key], part["code"], strict=True) for x in statements(code) or ()], schema=kind)

    return bundles.select(key, "code").mapInArrow(run, schema)


def bindings_of():
    return _column(bindings, "array<struct<name:string,start:int,end:int,role:string>>")


def declarations_of():
    return _column(declarations, "array<struct<ord:int,kind:string,name:string>>")


def scopes_of():
    return _column(scopes, "array<array<string>>")


def parseable():
    return _column(parses, "boolean")


def features_of():
    """Column function: text -> struct(strings, fingerprint)."""

    @F.pandas_udf("strings array<string>, fingerprint string")
    def run(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(x) for x in code], columns=["strings", "fingerprint"])

    return run
