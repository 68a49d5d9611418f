"""Layout of minified text: one statement a line, blocks indented.

Only white space before a statement, a class member or the brace that ends a block is changed, so
tokens, comments and literals stay as they are and the text keeps its meaning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from graphloom.parse.js import Node, ParseError, parse

TAB = "  "


def _cuts(program: Node) -> list[tuple[int, int]]:
    """Where lines begin, and how deep."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[Node, int]] = [(program, 0)]
    while stack:
        node, depth = stack.pop()
        inner = depth
        if node.type == "Program":
            out += [(n.start, depth) for n in node.body]
        elif node.type == "SwitchStatement" and node.cases:
            inner = depth + 1
            out += [(c.start, inner) for c in node.cases] + [(node.end - 1, depth)]
        elif node.type == "SwitchCase":
            inner = depth + 1
            out += [(n.start, inner) for n in node.consequent]
        elif isinstance(body := node.get("body"), list) and node.type in ("BlockStatement", "ClassBody", "ClassDeclaration", "ClassExpression") and body:
            inner = depth + 1
            out += [(n.start, inner) for n in body] + [(node.end - 1, depth)]
        stack += [(child, inner) for _, child in node.children()]
    return sorted(out)


def beautify(code: str | None) -> str | None:
    """The text laid out, its first ``#!`` line kept; texts that do not parse come back unchanged."""
    if code is None:
        return None
    head, body = "", code
    if code.startswith("#!"):
        cut = code.find("\n") + 1 or len(code)
        head, body = code[:cut], code[cut:]
    try:
        cuts = _cuts(parse(body))
    except (ParseError, RecursionError):
        return code
    parts, at, lead = [], 0, ""
    for start, depth in cuts:
        piece = body[at:start].strip(" \t\r\n")
        if piece:
            parts.append(lead + piece)
        at, lead = start, TAB * depth
    piece = body[at:].strip(" \t\r\n")
    if piece:
        parts.append(lead + piece)
    out = "\n".join(parts)
    return head + out + "\n" if out else head + body


def beautify_of():
    """Column function: text -> text."""

    @F.pandas_udf("string")
    def run(code: pd.Series) -> pd.Series:
        return pd.Series([beautify(x) for x in code], dtype=object)

    return run
