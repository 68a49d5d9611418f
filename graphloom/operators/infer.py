"""Name inference with a language model: prompts, answers, filters.  The client is given by the caller."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]
NAME = r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b"

# Keywords, and the names that are never given or taken.
KEYWORDS = (
    "do", "if", "in", "of", "for", "let", "new", "try", "var", "case", "else",
    "enum", "null", "this", "true", "void", "with", "await", "break", "catch", "class", "const", "false",
    "super", "throw", "while", "yield", "delete", "export", "import", "return", "switch", "typeof",
    "default", "extends", "finally", "function", "debugger", "arguments", "instanceof",
)
RESERVED = (*KEYWORDS, "implements", "name", "length", "prototype", "constructor", "__proto__", "exports", "module", "require", "undefined", "NaN", "Infinity")


def http_client(model: str, url: str = "http://localhost:11434/api/generate", timeout: float = 120) -> Client:
    """A client of a local generation service."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "options": {"temperature": 0, "num_predict": 2048}}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r).get("response", "")

    return ask


def silent_client(prompt: str) -> str:
    """The offline default: no suggestions."""
    return "[]"


def answers(text: str) -> list[dict]:
    """The pairs in a model's reply: fenced, bare or the whole text as a JSON array."""
    tries = [m[1] for p in (r"```json\s*(.*?)```", r"```\s*(.*?)```", r"(\[.*\])") if (m := re.search(p, text or "", re.S))]
    for t in [*tries, text or ""]:
        try:
            got = json.loads(t)
        except ValueError:
            continue
        if isinstance(got, list):
            return [x for x in got if isinstance(x, dict)]
    return []


def prompts(modules: DataFrame, paired: bool) -> DataFrame:
    """``module, prompt`` from ``(module, code[, ref_code])``, with 3,000 characters of each text.

    Paired: the first 50 names of up to four letters that the reference lacks, and the first 50 of five
    or more that the code lacks.  Alone: the first 30 of up to three letters.  Keywords are no names.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(NAME), F.lit(0)))
    keyword = F.array(*(F.lit(k) for k in (*KEYWORDS, "undefined")))
    shown = lambda ws, ok, n: F.array_join(F.slice(F.filter(F.array_except(ws, keyword), ok), 1, n), ", ")
    head = F.substring("code", 1, 3000)
    if paired:
        ask = F.concat(F.lit("Match short names to readable ones.\nShort names: "), shown(F.array_except(words("code"), words("ref_code")), lambda w: F.length(w) <= 4, 50), F.lit("\nReadable names: "), shown(F.array_except(words("ref_code"), words("code")), lambda w: F.length(w) >= 5, 50), F.lit("\nShort code:\n"), head, F.lit("\nReadable code:\n"), F.substring("ref_code", 1, 3000))
    else:
        ask = F.concat(F.lit("Suggest readable names.\nShort names: "), shown(words("code"), lambda w: F.length(w) <= 3, 30), F.lit("\nCode:\n"), head)
    return modules.select("module", F.concat(ask, F.lit('\nReply with a JSON array of {"minified": ..., "semantic": ...}.')).alias("prompt"))


def infer(modules: DataFrame, client: Client = silent_client, paired: bool = False) -> DataFrame:
    """``(module, ord, minified, semantic)``: plausible pairs that the client suggests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, k, str(a.get("minified", "")), str(a.get("semantic", ""))) for m, p in zip(pdf["module"], pdf["prompt"], strict=True) for k, a in enumerate(answers(client(p)))]
            yield pd.DataFrame(rows, columns=["module", "ord", "minified", "semantic"])

    got = prompts(modules, paired).mapInPandas(run, "module string, ord long, minified string, semantic string")
    return plausible(got)


def plausible(pairs: DataFrame) -> DataFrame:
    """Pairs of different names, the minified one of up to 4 letters, the semantic one of 3 or more."""
    return pairs.where((F.col("minified") != F.col("semantic")) & F.length("minified").between(1, 4) & (F.length("semantic") >= 3))


def against_truth(pairs: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that the known ones (``by``, minified, semantic) confirm or do not know."""
    known = truth.select(*by, "minified", F.col("semantic").alias("true_name"))
    j = pairs.join(known, [*by, "minified"], "left")
    return j.where(F.col("true_name").isNull() | (F.col("true_name") == F.col("semantic"))).drop("true_name")


def unreserved(pairs: DataFrame, reserved: DataFrame, key: str = "pair", side: str = "minified") -> DataFrame:
    """Pairs whose name on one side is not reserved: by ``reserved(name)`` everywhere, by ``reserved(pair, name)`` in its pair."""
    by = [key] if key in reserved.columns else []
    return pairs.join(reserved.select(*by, F.col("name").alias(side)).distinct(), [*by, side], "left_anti").select(*pairs.columns)
