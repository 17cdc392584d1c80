"""Symbols of Python source files as a table, and references that no longer point at them.

Files are parsed, never run, in Arrow batches; a file is one row.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "file string, symbol string, kind string, line long, end_line long"


def symbols(sources: DataFrame) -> DataFrame:
    """The classes and functions of sources (file, text): (file, symbol, kind, line, end_line), a symbol being its dotted path.

    Of definitions of one name side by side the first counts. Every file has one row without a symbol besides: of the kind `module`, or
    `invalid` if it is no Python or null.
    """

    def found(body: list[ast.stmt], path: str) -> Iterator[tuple[str, str, int, int]]:
        seen = set()
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.name not in seen:
                seen.add(node.name)
                yield f"{path}{node.name}", "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno
                yield from found(node.body, f"{path}{node.name}.")

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SPAN.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for part in parts:
            rows = []
            for file, text in zip(part.column("file").to_pylist(), part.column("text").to_pylist()):
                try:
                    rows += [(file, *s) for s in found(ast.parse(text).body, "")]
                    rows.append((file, None, "module", 1, text.count("\n") + 1))
                except (SyntaxError, ValueError, TypeError, RecursionError):
                    rows.append((file, None, "invalid", None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return sources.select(F.col("file").cast("string"), F.col("text").cast("string")).mapInArrow(scan, SPAN)


def drifted_references(pinned: DataFrame, spans: DataFrame) -> DataFrame:
    """References (file, symbol, line) that do not hold: with `now`, the symbol's line, and a reason.

    `moved`: the symbol starts on another line; `invalid`: the file has no such symbol, or is no Python. References to files that are not there, or
    to no symbol, say nothing.
    """
    known = spans.select("file").distinct()
    lines = spans.where("symbol IS NOT NULL").select("file", "symbol", F.col("line").alias("now"))
    joined = pinned.where("symbol <> ''").join(known, "file", "left_semi").join(lines, ["file", "symbol"], "left")
    reason = F.when(F.col("now").isNull(), "invalid").when(F.col("now") != F.col("line"), "moved")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("file", "symbol", "line", "now", "reason")
