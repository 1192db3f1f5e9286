"""Uploads: pasted files and archives, checked and unpacked as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.session import ship

#: Limits, names of specifications in order, and folders that are not read.
TOTAL_BYTES, FILES, FILE_BYTES, RULES = 1_500_000, 30, 150_000, 80
SPEC_NAMES = ["spec.md", "specification.md", "specs.md"]
SKIP = [".git", ".idea", ".vscode", ".venv", "__pycache__", ".pytest_cache", "node_modules", "dist", "build", "tests"]
UPLOAD_ID = "^[a-f0-9]{16}$"


def skipped(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, X.strings(SKIP)) | F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", ".."))


def safe_path(path: Column) -> Column:
    """The path in plain form; null if it is empty, absolute, climbs, or lies in a folder that is not read."""
    raw = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    bad = (F.size(parts) == 0) | F.array_contains(parts, "..") | raw.startswith("/") | F.arrays_overlap(parts, X.strings(SKIP))
    return F.when(~bad, F.array_join(parts, "/"))


def without_common_root(files: DataFrame, key: str) -> DataFrame:
    """Paths without the one folder that wraps all files of an upload."""
    head, nested = F.substring_index("path", "/", 1), F.instr("path", "/") > 0
    by = Window.partitionBy(key)
    wrapped = (F.min(nested).over(by)) & (F.min(head).over(by) == F.max(head).over(by))
    marked = files.withColumn("__wrapped", wrapped)
    return marked.withColumn("path", F.when(F.col("__wrapped"), F.expr("substring(path, instr(path, '/') + 1)")).otherwise(F.col("path"))).drop("__wrapped")


def preferred_sources(files: DataFrame, key: str) -> DataFrame:
    """Python files; only those under ``src/`` where an upload has some there."""
    python = files.where(F.col("path").endswith(".py") & ~F.array_contains(F.split("path", "/"), "tests"))
    under = F.startswith("path", F.lit("src/"))
    return python.withColumn("__any", F.max(under).over(Window.partitionBy(key))).where(~F.col("__any") | under).drop("__any")


def picked_spec(files: DataFrame, key: str) -> DataFrame:
    """(key, path, error): the specification of each upload. Named files win by depth, then name, then path; otherwise the
    Markdown file with the most rules, then depth, then path. Two named files of one rank are an error."""
    name = F.lower(X.base_name(F.col("path")))
    rank = F.array_position(X.strings(SPEC_NAMES), name)
    depth = F.size(F.split("path", "/")) - 1
    rules = F.size(F.regexp_extract_all("text", F.lit("(?m)" + X.RULE_LINE), F.lit(1)))
    rated = files.select(key, "path", rank.alias("rank"), depth.alias("depth"), rules.alias("rules")).where((F.col("rank") > 0) | (F.lower("path").endswith(".md") & (F.col("rules") > 0)))
    order = Window.partitionBy(key).orderBy((F.col("rank") == 0), F.when(F.col("rank") > 0, 0).otherwise(-F.col("rules")), "depth", "rank", "path")
    twins = F.count("*").over(Window.partitionBy(key, "rank", "depth"))
    first = rated.withColumn("twins", twins).withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select(key, "path", F.when((F.col("rank") > 0) & (F.col("twins") > 1), F.concat(F.lit("more than one "), X.base_name(F.col("path")))).alias("error"))


def upload_error(spec: Column, rules: Column, files: Column) -> Column:
    """The first reason to refuse an upload, or null. ``rules`` is a count, ``files`` a list of (path, source)."""
    size = lambda f: F.octet_length(f["source"])
    total = F.aggregate(files, F.lit(0), lambda n, f: n + size(f))
    return (
        F.when(F.trim(F.coalesce(spec, F.lit(""))) == "", "the specification is empty").when(rules == 0, "no numbered rules").when(rules > RULES, "too many rules")
        .when(F.size(files) <= 0, "no Python files").when(F.size(files) > FILES, "too many files").when(F.exists(files, lambda f: size(f) > FILE_BYTES), "a file is too large")
        .when(total > TOTAL_BYTES, "the files are too large")
    )


def valid_id(value: Column) -> Column:
    return value.rlike(UPLOAD_ID)


def unpacked(archives: DataFrame) -> DataFrame:
    """(upload, content) to (upload, path, text, warning, error): a row a usable file, or one with the reason to refuse.
    Limits hold before anything is inflated past them."""
    ship(archives.sparkSession)

    def rows(upload: str, content: bytes) -> list[tuple]:
        def refuse(why: str) -> list[tuple]:
            return [(upload, None, None, None, why)]

        if not content:
            return refuse("the archive is empty")
        if len(content) > TOTAL_BYTES:
            return refuse("the archive is too large")
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            return refuse("not a zip archive")
        out, total, tests = [], 0, 0
        for entry in (e for e in archive.infolist() if not e.is_dir()):
            name = entry.filename.replace("\\", "/")
            parts = [p for p in name.split("/") if p not in ("", ".")]
            if name.startswith("/") or ".." in parts:
                return refuse(f"unsafe path {entry.filename}")
            path = "/".join(parts)
            if "tests" in parts and path.endswith(".py"):
                tests += 1
                continue
            if any(p in SKIP or p.startswith(".") for p in parts) or not path.lower().endswith((".py", ".md")):
                continue
            total += entry.file_size
            if entry.file_size > FILE_BYTES or total > TOTAL_BYTES:
                return refuse(f"{path} is too large" if entry.file_size > FILE_BYTES else "the files are too large")
            try:
                out.append((upload, path, archive.read(entry).decode(), None, None))
            except (UnicodeDecodeError, zipfile.BadZipFile):
                return refuse(f"{path} is not UTF-8 text")
            if len(out) > FILES:
                return refuse("too many files")
        warned = f"skipped {tests} files of tests" if tests else None if out else "nothing to check"
        return out + ([(upload, None, None, warned, None)] if warned else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [r for u, c in zip(frame["upload"], frame["content"], strict=True) for r in rows(u, bytes(c or b""))]
            yield pd.DataFrame(found, columns=["upload", "path", "text", "warning", "error"])

    return archives.select("upload", "content").mapInPandas(run, "upload string, path string, text string, warning string, error string")
