"""Python sources to chunks: module constants, functions, class headers and methods."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship

DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def top_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def parts_of(tree: ast.Module) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(qualname, kind, line ranges) of a module: what stands outside definitions is one part, a class stops at its first
    method, and nothing inside a function is split."""
    loose = [n for n in tree.body if not isinstance(n, (*DEFINITIONS, ast.ClassDef))]
    if loose:
        yield "<module>", "module", [(top_line(n), n.end_lineno) for n in loose]
    for node in tree.body:
        if isinstance(node, DEFINITIONS):
            yield node.name, "function", [(top_line(node), node.end_lineno)]
        elif isinstance(node, ast.ClassDef):
            methods = [n for n in node.body if isinstance(n, DEFINITIONS)]
            end = top_line(methods[0]) - 1 if methods else node.end_lineno
            if end >= top_line(node):
                yield node.name, "class", [(top_line(node), end)]
            for method in methods:
                yield f"{node.name}.{method.name}", "method", [(top_line(method), method.end_lineno)]


def chunk_rows(path: str, source: str) -> list[dict]:
    """Chunks of one file; none if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = source.splitlines()
    return [
        {
            "chunk_id": f"{path}::{name}", "file": path, "qualname": name, "kind": kind, "start_line": ranges[0][0], "end_line": ranges[-1][1],
            "source": "\n".join("\n".join(lines[a - 1 : b]) for a, b in ranges),
        }
        for name, kind, ranges in parts_of(tree)
    ]


CHUNK = "chunk_id string, file string, qualname string, kind string, start_line int, end_line int, source string"


class Chunks:
    """Table function: the chunks of one Python file; no row if it does not parse."""

    def eval(self, path: str | None, source: str | None):
        for chunk in chunk_rows(path or "", source or ""):
            yield tuple(chunk.values())


def chunked(sources: DataFrame) -> DataFrame:
    """(workspace, path, source) to chunks, file by file, by a lateral join."""
    ship(sources.sparkSession)
    given = sources.select("workspace", F.col("path").alias("__path"), F.col("source").alias("__source"))
    rows = given.lateralJoin(F.udtf(Chunks, returnType=CHUNK)(F.col("__path").outer(), F.col("__source").outer()))
    return rows.drop("__path", "__source")


def changed_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after) to (keys, lines, before_line, after_line): numbers of added or replaced lines, and the one
    differing stretch between common beginning and end, cut to 120 characters."""
    import difflib

    ship(pairs.sparkSession)

    def stretch(a: list[str], b: list[str]) -> tuple[str, str]:
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        short = lambda x: " ".join(s.strip() for s in x if s.strip())[:120]
        return short(a[head : len(a) - tail]), short(b[head : len(b) - tail])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines, old, new = [], [], []
            for before, after in zip(frame["before"], frame["after"], strict=True):
                a, b = (before or "").splitlines(), (after or "").splitlines()
                steps = difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
                lines.append([k + 1 for tag, _, _, x, y in steps if tag in ("replace", "insert") for k in range(x, y)])
                x, y = stretch(a, b)
                old.append(x)
                new.append(y)
            yield frame[keys].assign(lines=lines, before_line=old, after_line=new)

    schema = pairs.select(*keys).schema.add("before_line", "string").add("after_line", "string")
    from pyspark.sql import types as T

    fields = [*pairs.select(*keys).schema.fields, T.StructField("lines", T.ArrayType(T.IntegerType())), *schema.fields[-2:]]
    return pairs.select(*keys, "before", "after").mapInPandas(run, T.StructType(fields))
