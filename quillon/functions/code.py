"""Code in answers: extraction and a sanitiser that parses it and never runs it."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCED = re.compile(r"```[^\n`]*\n([\s\S]*?)```")


def parsable(block: str) -> str:
    """A block without the lines at its end that keep it from parsing; empty if none of it parses."""
    rows = block.strip("\n").split("\n")
    for end in range(len(rows), 0, -1):
        text = "\n".join(rows[:end])
        try:
            if ast.parse(text).body:
                return text
        except (SyntaxError, ValueError):
            continue
    return ""


def sanitized(answer: str | None, entry_point: str | None) -> str:
    """The parsable code of an answer; its last top-level function gets the name ``entry_point`` if none has it."""
    blocks = _FENCED.findall(answer or "") or [answer or ""]
    code = "\n\n".join(x for x in map(parsable, blocks) if x)
    if not code or not entry_point:
        return code
    functions = [n for n in ast.parse(code).body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if functions and entry_point not in {n.name for n in functions}:
        code = re.sub(rf"\b{re.escape(functions[-1].name)}\b(?=\s*\()", entry_point, code)
    return code


def sanitize(answer: Column, entry_point: Column) -> Column:
    def run(answers: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([sanitized(a, n) for a, n in zip(answers.to_pylist(), names.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(answer, entry_point)
